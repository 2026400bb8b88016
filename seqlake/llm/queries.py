"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import toxicity
from seqlake.llm.common import crc32_mod, spread, table
from seqlake.llm.gif import store_and_digest
from seqlake.llm.hnsw import search_all
from seqlake.llm.language_id import identify
from seqlake.llm.mixing import mix, mix_sql
from seqlake.llm.ngram_join import similar_components
from seqlake.llm.packing import pack
from seqlake.llm.suffix_array import remove_duplicates
from seqlake.llm.token_counts import count_tokens
from seqlake.llm.url_filter import judge
from seqlake.llm.url_sql import judge_sql


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_all(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 100 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return kept.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("est_tokens"), F.round("mix_weight", 6).alias("cell_weight"), F.round("mix_prob", 6).alias("keep_prob"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, train=~held_out, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_digest(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), words=3, percent=90)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spread(table(spark, sf_dir, name)) for name in ("documents", "labels"))
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    scored = toxicity.score(docs, toxicity.fit(docs, labels, learn=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_nearest": op2_nearest,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_gif_media": op8_gif_media,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {
    "op3_mixing": mix_sql("select doc_id, text, lang, source from documents", "doc_id, d.source, d.lang, d.topic, tokens as est_tokens, round(weight, 6) as cell_weight, round(prob, 6) as keep_prob"),
    "op6_url_filter": judge_sql(),
}
