"""A corpus pipeline: language, near duplicates, repeated passages, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import column, crc32_mod, cut, map_rows, spread
from seqlake.llm.language_id import identify
from seqlake.llm.mixing import mix
from seqlake.llm.ngram_join import similar_rows
from seqlake.llm.packing import pack
from seqlake.llm.suffix_array import remove_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language can't be told; the others keep their ``lang``, or get the one found where it is null."""
    found = identify(spread(docs), train=crc32_mod("doc_id", 4) != 2).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Every row is a document of its own: rows whose ids are null or equal stay unless their texts are near duplicates. Null
    counts as the largest id; of rows with one id the least hash of the text decides, and of full copies one stays. Rows
    without words all stay.
    """
    first = similar_rows(spread(docs), words=5, percent=80).where("first")
    kept = cut(first.groupBy(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("none"), "t").agg((F.count("*") > 1).alias("again"), (F.max("size") > 0).alias("worded")), "kept")
    rows = docs.select("*", F.struct(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).alias("key"))

    def meeting(keys: DataFrame) -> DataFrame:
        return rows.join(keys, (rows["key.k"] == keys["k"]) & (rows["key.none"] == keys["none"]) & (rows["key.t"] == keys["t"]), "left_semi")

    copies = kept.where("again and worded")
    if not copies.limit(1).count():
        return meeting(kept).select(*docs.columns)
    return meeting(kept.where("not (again and worded)")).unionByName(meeting(copies).dropDuplicates(["key"])).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes or more that occur again, in any document; halves of characters go with them.

    Every row stays one row, whether its id is null, repeated or neither. Null texts become empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = remove_duplicates(spread(docs), keep=rest)

    def decode(batch) -> dict:
        text = [x.decode(errors="ignore") for x in column(batch, "kept").to_pylist()]
        return {"text": text, "n_chars": [len(x) for x in text]} | {c: column(batch, c) for c in ("doc_id", *rest)}

    return map_rows(kept.select("doc_id", "kept", *rest), decode, docs.schema)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics come near their target weights."""
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return pack(spread(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can't express compression, suffix arrays or the linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
