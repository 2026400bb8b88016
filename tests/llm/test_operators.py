"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from seqlake.llm import gif, hnsw, language_id, mixing, ngram_join, packing, queries, suffix_array, token_counts, toxicity, url_filter
from seqlake.sources import staging

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "a passage that stands in two of these documents and is long enough to be found, word for word, wherever it is put in them " * 2
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six seven eight nine ten", "en", "s", 1),
    (4, "one two three four five six seven eight nine ten", "en", "s", 1), (5, "x " + PASSAGE + "y", "en", None, 2), (6, "other " + PASSAGE + "words", None, "s", 3),
    (7, "long " * 30000, "en", "s", 4), (8, "123 456", "de", "t", 5), (8, "123 456", "de", "t", 5), (None, "no id here", "de", "t", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("n_tokens", "k", "t", "token", "kind", "id", "length")})


def test_token_counts(docs):
    got = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ROWS) and {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_language(docs):
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, F.lit(True), keep=["doc_id"]).collect()}
    assert got[1] == got[2] == got[8] == "und"
    assert language_id.identify(docs.limit(0), F.lit(True)).count() == 0


def test_dictionaries_count_copies_once(spark):
    texts = [f"texto numero {chr(97 + i % 26)}{chr(97 + i // 26)} de los que hay en esta lengua" for i in range(40)]
    rows = spark.createDataFrame([(x, "es") for x in texts] + [(f"words {chr(97 + i)} of it", "en") for i in range(9)], "text string, lang string")
    copies = spark.range(20000).select(F.lit("una copia que se repite").alias("text"), F.lit("es").alias("lang"))
    one = language_id.fit_dictionaries(rows.unionByName(copies.limit(1)), texts_per_lang=20)
    assert language_id.fit_dictionaries(rows.unionByName(copies), texts_per_lang=20) == one and sorted(one) == ["en", "es"]
    assert all(language_id.fit_dictionaries(rows, texts_per_lang=1e-9).values())


def test_gif(docs):
    stored = gif.store_texts(docs)
    assert stored.count() == len(ROWS)
    got = gif.store_and_digest(docs).collect()
    payload = {r.doc_id: r for r in got}
    assert payload[1].payload_bytes == 576 and payload[1].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert len(got) == len(ROWS) and payload[3][1:] == payload[4][1:] and payload[7].payload_bytes == 150336
    assert len([r for r in got if r.doc_id == 8]) == 2 and len({tuple(r) for r in got if r.doc_id == 8}) == 1
    assert gif.read_frames(stored.where("doc_id = 3")).first()["frames"][0]["delay_ms"] == 100
    assert gif.read_frames(stored.select("doc_id", F.lit(b"junk").alias("media"))).where("frames is not null").count() == 0
    assert gif.store_and_digest(docs.limit(0)).count() == 0


def test_media_query_against_brute_force(spark):
    """Payload, checksums, media and histogram of every document, worked out again in Python."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_gif_media(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        media = gif.encode_gif(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"frames={-(-len(payload) // 9216)};ms=")


def test_frames_keep_colours_and_holes(spark):
    """A coloured animation with transparent pixels, stored and read as columns."""
    head = b"GIF89a\x02\x00\x01\x00\xf1\x00\x00" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    code = gif.lzw_encode(b"\x01\x03", 2)
    data = head + b"\x21\xf9\x04\x01\x07\x00\x03\x00" + b"\x2c" + b"\0\0\0\0\x02\0\x01\0\0" + b"\x02" + bytes([len(code)]) + code + b"\0\x3b"
    (f,) = gif.read_frames(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).first()["frames"]
    assert (f.channels, f.delay_ms, bytes(f.shown), f.colour_sums, sum(f.histogram)) == (3, 70, b"\1\0", [255, 0, 0], 1)
    assert bytes(f.pixels)[:3] == bytes([255, 0, 0])


def test_ngram_join(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs, words=3, percent=90).where("doc_id is not null").collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == got[4] == (8, 3) and got[7] == (1, 7) and got[8] == (1, 8)
    assert ngram_join.similar_components(docs.limit(0)).count() == 0


ODD = [
    (None, "a clean text of its own that no other row is like at all", "en", "s", 1), (None, "and one more clean text which differs from all the rest here", "en", "s", 2),
    (None, "a text whose copy has an id and so goes before this row", "en", "s", 3), (5, "a text whose copy has an id and so goes before this row", "en", "s", 4),
    (7, "two rows with this id have texts that differ, this is one", "en", "s", 5), (7, "while the second of them says something else in its words", "en", "s", 6),
    (8, "a row that stands here twice, with its id and all it has", "en", "s", 7), (8, "a row that stands here twice, with its id and all it has", "en", "s", 7),
    (None, "a row without an id that stands here twice in the same words", "en", "s", 8), (None, "a row without an id that stands here twice in the same words", "en", "s", 8),
    (None, None, "en", "s", 9), (None, "", "en", "s", 10), (9, "", "en", "s", 11), (9, "", "en", "s", 11),
]


def test_rows_without_and_with_repeated_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = ngram_join.similar_components(docs, words=3, percent=80).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert Counter((r.doc_id, r.component_id) for r in got if r.doc_id != r.component_id) == Counter({(None, 5): 1})
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = Counter((i, x) for i, x, *_ in ODD) - Counter({(None, ODD[2][1]): 1, (8, ODD[6][1]): 1, (None, ODD[8][1]): 1})
    assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == want
    cleaned = corpus_pipeline.passages(spark, docs, SF)
    assert cleaned.columns == docs.columns and Counter((r.doc_id, r.text, r.source) for r in cleaned.collect()) == Counter((i, x or "", s) for i, x, _, s, _ in ODD)


def test_suffix_dedup(docs):
    texts = [r[1] or "" for r in ROWS]
    count = Counter(x.encode()[i : i + 200] for x in texts for i in range(len(x.encode()) - 199))
    want = []
    for (i, *_), x in zip(ROWS, texts, strict=True):
        data = x.encode()
        gone, upto = 0, 0
        for a in range(len(data) - 199):
            if count[data[a : a + 200]] > 1:
                gone += a + 200 - max(a, upto)
                upto = a + 200
        want.append((i or 0, len(data), gone))
    for block in (suffix_array.BLOCK, 3000, 1):  # with the smallest block every anchor is split until its groups are one string
        got = suffix_array.remove_duplicates(docs, block=block).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in got) == sorted(want)
    assert suffix_array.remove_duplicates(docs.limit(0)).count() == 0


def test_suffix_dedup_of_many_variants(spark):
    """A passage in many surroundings, copies, overlapping repeats, and a long text in pieces, against brute force at every block size."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, long = noise(260), noise(5000)
    texts = [noise(rng.randrange(0, 120)) + passage[rng.randrange(0, 30) : 260 - rng.randrange(0, 30)] + noise(rng.randrange(0, 150)) for _ in range(25)]
    texts += [long, long[1234:2500] + noise(50), "ab" * 400, texts[0], texts[0], "é" * 150, "x" + "é" * 150]
    count = Counter(x.encode()[i : i + 200] for x in texts for i in range(len(x.encode()) - 199))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    for block in (suffix_array.BLOCK, 3000, 1):
        for r in suffix_array.remove_duplicates(rows, block=block, piece=700).collect():
            data = texts[r.doc_id].encode()
            gone = {j for i in range(len(data) - 199) if count[data[i : i + 200]] > 1 for j in range(i, i + 200)}
            assert bytes(r.kept) == bytes(x for j, x in enumerate(data) if j not in gone), (block, r.doc_id)


def test_packing(docs):
    got = packing.pack(docs, P.path("word_bpe_49k.json")).orderBy("sequence_id", "offset").collect()
    at = Counter()
    for r in got:
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and sum(r.doc_tokens for r in got if r.start == 0) == sum(at.values())
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_mixing(docs):
    got = mixing.mix(docs, keep=1.0).collect()
    assert len(got) <= len(ROWS) and all(0 < r.mix_prob <= 1 for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("mix_prob", F.lit(1)))


def test_raked_margins_are_the_targets(spark):
    """Every margin's shares are its targets; null is a value; ties and hot cells don't matter; what contradicts is told."""
    rng = random.Random(5)
    rows = [(s, la, t, rng.randint(1, 50) * (900 if s == "a" else 1)) for s in ("a", "b", None) for la in ("en", "de", None) for t in ("x", "y")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"lang": {"en": 0.5, None: 0.2}, "source": {"a": 0.25}, "topic": {"x": 0.5, "gone": 0.5}}
    raked, miss = mixing.rake(cells, mixing.MARGINS, 0.7, targets)
    found = raked.collect()
    share = lambda m, v: sum(r["weight"] for r in found if r[m] == v)
    assert miss <= 1e-9 and abs(share("lang", "en") - 0.5) < 1e-9 and abs(share("lang", None) - 0.2) < 1e-9 and abs(share("source", "a") - 0.25) < 1e-9
    free = {v: sum(r[3] for r in rows if r[0] == v) ** 0.7 for v in ("b", None)}
    assert abs(share("source", "b") - 0.75 * free["b"] / sum(free.values())) < 1e-9
    assert abs(share("topic", "x") - 0.5 / (0.5 + 0.5)) < 1e-9  # the rest goes to the values that there are
    apart = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], cells.schema)
    with pytest.warns(UserWarning, match="missed"):
        _, miss = mixing.rake(apart, mixing.MARGINS, 1.0, {"source": {"a": 0.9}, "lang": {"en": 0.1}})
    assert miss > 0.5
    calibrated = mixing.calibrate(raked, 0.5).collect()
    assert abs(sum(r.tokens * r.keep_prob for r in calibrated) - 0.5 * sum(r[3] for r in rows)) < 1e-6 * sum(r[3] for r in rows)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train([], [], 0)).count() == 0


def test_nearest(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.search_all(vectors, lambda i: i % 20 == 0, shard=10).collect()
    assert {r.query_id for r in got} == {0, 20}
    assert [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 0][:5] == [7, 14, 21, 28, 35]
    assert hnsw.search_all(vectors.limit(0), lambda i: i % 20 == 0).count() == 0


def test_nearest_of_several_shards_against_brute_force(spark):
    """The query's own table, dealt to many shards, with columns of clashing names and a repeated row and id."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").withColumns({c: F.lit("clash") for c in ("id", "dim", "v", "shard", "row", "block")})
    first = rows.where("embedding is not null").orderBy("vec_id").limit(1)
    rows = rows.unionByName(first).unionByName(first.withColumn("embedding", F.array(*[F.lit(1.0)] * len(first.first()["embedding"]))))
    found = hnsw.search_all(rows, lambda i: i % 20 == 0, shard=60).collect()
    table = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, v = np.array([i for i, _ in table]), np.array([x for _, x in table])
    asked = {}
    for i, x in table:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, x), x, key=tuple)
    assert {r.query_id for r in found} == set(asked)
    hit = 0
    for q, x in asked.items():
        dist = np.sqrt(((v - x) ** 2).sum(1))
        want = sorted((d, i) for d, i in zip(dist.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in got] == list(range(1, 11)) and [s for _, _, s in got] == sorted(s for _, _, s in got)
        assert all(abs(s - dist[ids == i].min()) < 1e-9 or len(dist[ids == i]) > 1 for _, i, s in got)
        hit += len({i for _, i, _ in got} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(asked)


def test_urls(spark):
    rows = [(1, "http://WWW.example.com/en/a?x", '<a href="https://bad.net/q">'), (2, "https://example.com/en/", None), (3, None, None), (4, "no scheme", ""), (5, "http://a.net/fr/x", ""), (6, "http://a.net/de/x", ""), (7, "http://example.com", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("net/fr/", "block") and got[6][2:] == (None, "block")
    assert got[7] == ("example.com", "", None, got[7][3])


LINKED = [
    (1, "http://seed.com/", '<a href="http://good.org/x"> <a href=//good.org/y>'), (2, "http://good.org/a", '<a href="https://far.org/">'), (3, "http://far.org/", '<A HREF=\'HTTP://FAR2.org\'>'),
    (4, "http://farm.org/", '<a href="http://spam.net/fr/q"><a href="http://seed.com">'), (5, "http://spam.net/fr/q", ""), (6, "http://hub.org/", '<a href="http://farm.org/"><a href="http://farm.org/2">'),
    (7, "http://hub2.org/", '<a href="http://hub.org/">'), (8, "http://alone.org/", None), (8, "http://alone.org/", None), (None, None, '<a href="http://x.org">'), (9, "no scheme", ""), (10, "://only/path", "<a href='/rel'>"),
    *[(100 + i, f"http://c{i}.org/", f'<a href="http://c{i + 1}.org/">') for i in range(30)], (131, "http://c30.org/", '<a href="http://spam.net/fr/q">'),
]


def test_urls_follow_links_to_the_end(spark):
    """Trust and distrust along real links, over chains longer than any fixed number of rounds, against SQL and plain power iteration."""
    pages = spark.createDataFrame(LINKED, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "rank", "kind", "trust", "src")})
    got = url_filter.judge(pages).collect()
    assert len(got) == len(LINKED)
    verdict = {r.host: r.verdict for r in got}
    assert verdict["farm.org"] == verdict["hub.org"] == verdict["c30.org"] == "block" and verdict["good.org"] == verdict["far.org"] == verdict["alone.org"] == verdict[""] == "allow"
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(f"select page_id, host, path, rule, verdict from ({queries.SQL['op6_url_filter']})").fetchall()
    assert Counter(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == Counter(str((None if x[0] is None or x[0] != x[0] else int(x[0]), *x[1:])) for x in want)
    rank, other = ({r.host: (r.trust, r.distrust, r.verdict) for r in found} for found in (got, url_filter.judge(pages, small=0).collect()))
    floor = url_filter.FLOOR * url_filter.SETTLED / len(rank)
    assert all(abs(a[0] - other[h][0]) <= floor and abs(a[1] - other[h][1]) <= floor and a[2] == other[h][2] for h, a in rank.items())
    rank = {r.host: r.distrust for r in got}
    chain = [rank[f"c{i}.org"] for i in range(31)]
    assert all(abs(a / b - url_filter.DAMPING) < 0.05 for a, b in zip(chain[20:], chain[21:], strict=False)) and chain[0] > 0
    assert url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({queries.SQL[name]})").fetchall()
    assert Counter(str(tuple(r)) for r in got.select(*names).collect()) == Counter(map(str, want))


def test_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().lower())
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in queries.op9_ngram_join(spark, SF).collect()}
    assert got == label


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 200])
def test_links_equal_brute_force(spark, block):
    """Groups of many similar texts, with copies, in one block and in many."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:20] + [f"x{i}"] + words[20:]) for i in range(12)] + [" ".join(words)] * 3 + [" ".join(words[:i]) for i in range(40, 60)] + ["alone in all this", ""]
    rows = [(i if i % 5 else None, x) for i, x in enumerate(texts)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    want = [sum(k != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for k, b in enumerate(sets)) for j, a in enumerate(sets)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80, block=block).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, n) for (i, _), n in zip(rows, want, strict=True))


def test_chance_tokens_hold_no_group_together(spark, monkeypatch):
    """Every set shares a token with every other one, none of them enough: nothing is left to verify."""
    written, cut = {}, ngram_join.cut

    def counted(df, name):
        out = cut(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    rows = [(i, " ".join(f"w{min(i, j)}x{max(i, j)}" for j in range(60) if j != i)) for i in range(60)]
    rows += [(60 + i, rows[i][1] + " more") for i in range(2)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=90, block=500).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (i % 60, int(i in (0, 1, 60, 61))) for i in range(62)}
    assert written["candidates"] == 4


@pytest.mark.parametrize("dense", [2, 1000])
def test_near_edges_connect_every_fitting_pair(dense):
    r = random.Random(dense)
    rows = [(part, run, d, size) for d, part, size in ((d, r.randrange(2), r.randrange(1, 30)) for d in range(40)) for run in r.sample(range(25), r.randrange(25))]
    a, b = ngram_join.near_edges(*(np.array(x, np.int64) for x in zip(*rows, strict=True)), 80, dense)
    near = {d: {d} for d in range(40)}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        joined = near[x] | near[y]
        near |= dict.fromkeys(joined, joined)
    sets = {}
    for part, run, d, size in rows:
        sets.setdefault((part, d, size), set()).add(run)
    for (p, d, n), x in sets.items():
        for (q, e, m), y in sets.items():
            if p == q and 100 * n >= 80 * m and n <= m and len(x & y) > ngram_join.extra_size(n, 80):
                assert e in near[d]


def test_groups_in_blocks_are_the_same(spark):
    r = random.Random(1)
    rows = [(run, d, 20 + d % 30) for d in range(200) for run in r.sample(range(d // 10 * 8, d // 10 * 8 + 12), 8)]
    met = spark.createDataFrame(rows, "run long, d1 long, size long")
    groups = spark.createDataFrame([(d, 0) for d in range(200)], "node long, component long")
    one, many = ({r.node: r.component for r in ngram_join.near_groups(met, groups, 80, listed).collect()} for listed in (10**6, 50))
    assert one == many and len(set(one.values())) > 1


def test_written_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(staging.FREED, None)
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(b.isShuffle() for b in (lambda x: [x.apply(i) for i in range(x.size())])(store.getAllBlocks()))
    kept = held()
    found = staging.cut(spark.range(1000).groupBy(F.col("id") % 7).count(), "counted")
    assert held() <= kept and spark.conf.get(staging.FREED, None) == before
    assert found.count() == 7


def test_word_ids_are_the_librarys_and_held_once(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED", 50)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    ids, whole = packing.WordIds(vocabulary), Tokenizer.from_str(vocabulary)
    letters = "abIİßéÉ''st.,-12<|>ɐΣ "
    r = random.Random(2)
    for text in ["".join(r.choices(letters, k=60)) for _ in range(300)] + ["İ i̇ ̇", "Don't ''s 's t", "Then then, then. THEN"]:
        assert np.frombuffer(ids.text(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sum(len(c) + len(c.older) for c in vars(ids).values() if isinstance(c, packing.Cache)) <= 2 * 50


def test_pipeline_stages_hand_on(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
            docs = corpus_pipeline.cut(docs, "test")
            assert docs.count() <= seen
            seen = docs.count()
    assert docs.select("doc_id").distinct().count() == seen
