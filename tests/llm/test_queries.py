"""The queries over whole tables against brute force, the library, held-out accuracy; stages of the pipeline on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from seqlake.llm import gif, language_id, packing, queries, token_counts, toxicity, url_filter

SF, MORE, MOST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a very long text of many words " * 20000
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same words stand in two of these rows and so they are near", "en", "s", 1), (4, "the same words stand in two of these rows and so they are near", None, "s", 1),
    (5, LONG, "en", None, 9), (8, "123 456", "de", "t", 5), (8, "123 456", "de", "t", 5), (None, "no id here but some words of its own in a row", "de", "t", 6), (None, None, None, None, None), (9, " \n\t ", "fr", "u", 4),
]


def texts_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def held(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


def test_token_counts_query_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: (len(x.encode()), len(library.encode(x)), len(library.encode(x)) > 4096) for i, x in texts_of(spark, SF).items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, SF).collect()} == want
    one = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    assert token_counts.count_tokens(one, P.path("piece_bpe_32k.model")).first().n_tokens == len(library.encode(LONG))


def test_summaries_of_many_partitions_are_merged(spark):
    """More partitions than are merged at once, one word in all of them, and no shuffle by word."""
    docs = spark.range(4000).repartition(70).select(F.concat(F.lit("everywhere w"), (F.col("id") % 900).cast("string")).alias("text"))
    found = token_counts.frequent_pretokens(docs, rows=50)
    assert found[0] == " everywhere" and len(found) == 50


def test_packing_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    library, length = Tokenizer.from_file(P.path("word_bpe_49k.json")), 2048
    ids = {i: library.encode(x, add_special_tokens=False).ids + [1] for i, x in texts_of(spark, SF).items()}
    got, taken, seen = queries.op4_packing(spark, SF).collect(), defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        taken[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, r.length))
    for spans in [*seen.values(), *taken.values()]:
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    assert all(sum(n for _, n in s) == len(ids[i]) for i, s in seen.items()) and set(seen) == set(ids)
    assert all(sum(n for _, n in s) <= length for s in taken.values())
    assert sum(map(len, ids.values())) >= 0.95 * length * len(taken)


def test_classes_are_ranked_in_parts(spark, monkeypatch):
    """Small parts give the same cover: every piece has one place."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 7 * 300 + 1).cast("int")).alias("text"))
    monkeypatch.setattr(packing, "RANKED", 9)
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and sum(at.values()) == sum(r.doc_tokens for r in got if r.start == 0) and len({r.doc_id for r in got}) == 300


def test_languages_of_held_out_texts(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    got = queries.op5_language_id(spark, MORE).collect()
    assert len(got) == len(lang) and all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.95
    assert {r.lang_pred for r in got} <= {*lang.values(), "und"}


def test_languages_at_the_edges(spark):
    """A clash of names, a very long text, a narrow margin, one language, too many languages."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    with pytest.raises(ValueError):
        language_id.identify(docs.withColumn("margin", F.lit(1)), F.lit(True))
    model = {"a": b"alpha beta gamma delta " * 300, "b": b"alpha beta gamma delta " * 300, "c": b"other words of it " * 300}
    rows = spark.createDataFrame([(1, "alpha beta gamma " * 9000), (2, "other words of it"), (3, None), (4, "alpha beta")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in language_id.identify(rows, F.lit(False), keep=["doc_id"], model=model).collect()}
    assert got[1].lang_pred == "a" and got[1].rejected and got[4].rejected and got[2].lang_pred == "c" and not got[2].rejected and got[3].lang_pred == "und"
    many = spark.range(60).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), (F.least("id", F.lit(9))).cast("string")).alias("lang"))
    assert sorted(language_id.fit_dictionaries(many, languages=3)) == ["l0", "l1", "l9"]
    assert language_id.fit_dictionaries(many.limit(0)) == {}


def test_toxic_held_out_texts(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MOST}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, MOST).collect()
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    out = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and toxic.get(r.doc_id) in (0, 1)]
    bad, good = [s for s, t in out if t], [s for s, t in out if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) >= 0.9
    assert np.mean([(s >= 0.5) == bool(t) for s, t in out]) >= 0.93


def test_samples_hold_their_bound(spark):
    """A third of all rows are copies of one text; no sample has it more than once, or more texts than asked for."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one copied text").otherwise(F.concat(F.lit("own words number w"), F.col("id").cast("string"))).alias("text"), F.lit("clash").alias("k"), F.lit("clash").alias("places"), F.lit("clash").alias("toxic"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    sizes = {}
    was = toxicity.train
    try:
        toxicity.train = lambda p, u, prior: sizes.update(p=len(p), u=len(u), prior=prior) or was(p, u, prior)
        toxicity.fit(docs, labels, F.lit(True), positives=40, unlabelled=500)
        assert sizes["p"] <= 40 and 300 <= sizes["u"] <= 500 and abs(sizes["prior"] - 0.1) < 1e-9
        model = toxicity.fit(docs, labels, F.lit(True), positives=10**6, unlabelled=10**6)
        assert sizes["u"] == 2001 and sizes["p"] == 201
    finally:
        toxicity.train = was
    got = toxicity.score(docs, model).collect()
    assert len(got) == 3000 and len({r.score for r in got if r.doc_id % 3 == 0}) == 1


def test_urls_repeat_and_may_be_missing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<a href='http://b.org'>")] * 3 + [(2, None, None), (2, "http://A.ORG", None)], "page_id long, url string, html string")
    got = url_filter.judge(pages.withColumn("verdict", F.lit("clash")).withColumn("rule", F.lit("clash"))).collect()
    assert Counter((r.page_id, r.host, r.path) for r in got) == {(1, "a.org", "/x"): 3, (2, "", ""): 1, (2, "a.org", ""): 1}


def test_media_of_equal_texts(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"media": F.lit("clash"), "frames": F.lit("clash"), "n_bytes": F.lit("clash")})
    got = gif.store_and_digest(docs).collect()
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.n_bytes, r.media_sha256, r.feature, r.tail_crc32))
    assert len(got) == len(ODD) and all(len(v) == 1 for v in by_text.values())
    assert {r.doc_id: r.n_bytes for r in got}[5] == len(LONG)


# ---------------------------------------------------------------- the pipeline's stages, each alone


@pytest.fixture
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_stage_language(spark, stages):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = stages["language id"](spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got) <= rows_of(docs) + Counter({(4, ODD[3][1], "en", "s"): 1})
    left = {r.doc_id for r in got.collect()}
    assert not left & {1, 2, 8, 9} and stages["language id"](spark, docs.limit(0), SF).count() == 0


def test_stage_near_duplicates(spark, stages):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = stages["near duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({1: 1, 2: 1, 3: 1, 5: 1, 8: 1, None: 2, 9: 1})
    assert stages["near duplicates"](spark, docs.limit(0), SF).count() == 0


def test_stage_passages(spark, stages):
    docs = spark.createDataFrame([*ODD, (20, "start " + "shared passage of many words " * 9 + "end", "en", "s", 1), (21, "other " + "shared passage of many words " * 9, "en", "s", 1)], SCHEMA)
    got = stages["repeated passages"](spark, docs, SF)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in docs.collect())
    by = {r.doc_id: r for r in got.collect()}
    assert by[20].text == "start end" or len(by[20].text) < 40
    assert by[3].text == ODD[2][1] and by[1].text == "" and len(by[5].text) < 64 and by[21].n_chars == len(by[21].text)
    assert stages["repeated passages"](spark, docs.limit(0), SF).count() == 0


def test_stage_mixture(spark, stages):
    docs = spark.createDataFrame(ODD * 30, SCHEMA)
    got = stages["mixture"](spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got) <= rows_of(docs) and got.count() > 0
    assert stages["mixture"](spark, docs.limit(0), SF).count() == 0


def test_stage_packing(spark, stages):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = stages["packing"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r[0] for r in ODD)
    assert stages["packing"](spark, docs.limit(0), SF).count() == 0


def test_pipeline_on_clashing_columns(spark, stages):
    """Columns of any other name go through all stages but the last."""
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(7) for c in ("k", "t", "id", "node", "h", "lo", "score_", "cls", "part", "size", "weight")})
    for name in list(stages)[:-1]:
        got = stages[name](spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.where("k <> 7").count() == 0


def test_payload_hashes_agree(spark):
    """Empty and null texts are one block of 255."""
    got = gif.store_and_digest(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {r.payload_sha256 for r in got} == {hashlib.sha256(b"\xff" * 576).hexdigest()} and re.fullmatch(r"frames=1;ms=100;mean=255.000,255.000,255.000;bins=63:1000", got[0].feature)
