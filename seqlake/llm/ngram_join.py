"""Similarity join of documents on the Jaccard similarity of their word n-grams.

Texts with equal n-gram sets form a class; classes are joined. Two sets as similar as asked must share a token among the
first ``p(n) = n - ceil(s n) + 1`` of each under any total order of all tokens, and ``e + 1`` tokens if ``e`` more of each
are looked at. The first order puts the corpus's rare tokens first (by a fixed-size count sketch over all documents): its
prefixes, a third longer, meet by token, and only classes that share enough tokens with one class of fitting size go on,
grouped by such pairs: tokens that two classes have in common by chance, more of them in a larger corpus, hold no group
together. Within a group a pair must also share prefix tokens under two other orders, and only pairs that
pass all three filters are verified, every one of them and each in one task: links are counted, not only what connects.
Where a prefix meets most sets of its group, all sets of fitting size are verified and the filters left out. Large groups
are cut into blocks that meet pairwise, so that no task holds more than two blocks; a task returns a sum of links for each
class and edges that connect what links, never the pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import arrow_schema, column, cut, drop, forget, kept, map_batches, map_rows, small_side, texts, trim
from seqlake.llm.graph import components

#: Counters of the sketch, n-grams of a block, and words that a worker keeps.
COUNTERS, BLOCK, CACHED = 1 << 18, 500_000, 150_000
#: Rows of a meeting partition, and parts of a token that the sketch counts among the heaviest.
MEETING, SALTS = 1_000_000, 64
#: Rows of a block in which shared tokens are counted, and sets of a token beyond which they are taken together uncounted.
LISTED, DENSE = 500_000, 1_000
#: Odd multipliers (fixed values of a common 64-bit hash).
MULTIPLIERS = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Words(dict):
    """A word's 64-bit hash; bounded, as long-lived as the worker."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def shingles(self, text: str, n: int) -> np.ndarray:
        """Sorted distinct hashes of the n-grams: words are what ASCII white space separates, A-Z lower-cased."""
        words = text.encode().lower().split()
        if len(words) < n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        at = len(words) - n + 1
        mixed = np.zeros(at, np.uint64)
        for k in range(n):
            mixed = scramble(mixed + h[k : k + at], 1)
        return np.unique(mixed)


def scramble(x: np.ndarray, k: int) -> np.ndarray:
    """A bijection of 64-bit numbers, another for each ``k``."""
    x = x * np.uint64(MULTIPLIERS[k % 3]) + np.uint64(k)
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(MULTIPLIERS[(k + 1) % 3])
    return x ^ (x >> np.uint64(29))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def extra_size(n: int, percent: int) -> int:
    """Tokens that are looked at beyond the prefix; never fewer for a larger set."""
    return prefix_size(n, percent) // 3


def needed(n: int, percent: int) -> int:
    """Shared tokens that a set of ``n`` must have with a similar one, which may be as small as ``percent`` of it."""
    return extra_size(-(-n * percent // 100), percent) + 1


def rare_first(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The n-grams ordered by the sketch's count, ties by hash."""
    return shingles[np.argsort(sketch[shingles % np.uint64(len(sketch))], kind="stable")]


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def keyed_texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, text, t`` (a hash of the text) for each row. Null texts count as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))


def shingle_rows(keyed: DataFrame, n: int) -> DataFrame:
    """``kind`` 0: ``id, t, size, d1, d2`` for each row; ``kind`` 1: a partition's sketch as (``id``: counter, ``size``: count)."""
    key, schema = uuid.uuid4().hex, pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("size", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = kept(key, Words), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sets = [words.shingles(x, n) for x in texts(batch)]
            for s in sets:
                np.add.at(counts, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), column(batch, "id"), column(batch, "t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())], schema=schema)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), none, pa.array(counts[at]), none, none], schema=schema)

    return map_batches(keyed, run, "kind int, id long, t long, size long, d1 long, d2 long", key)


def runs_of(token: np.ndarray, salt: np.ndarray, d1: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, d1, size): sets that share a token, cut where one is too small for the next larger one.

    A run is named by its token and its place among the token's runs, so it holds every pair of fitting size. Runs of
    one set are left out. The parts of a salted token can't see each other: all its rows go on as one run.
    """
    order = np.lexsort((d1, size, token))
    token, salt, d1, size = token[order], salt[order], d1[order], size[order]
    if not len(token):
        return token, d1, size
    new = np.append(True, (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:]))
    new[1:] &= ~((token[1:] == token[:-1]) & (salt[1:] >= 0) & (salt[:-1] >= 0))
    again = np.append(False, (token[1:] == token[:-1]) & (d1[1:] == d1[:-1]) & (salt[1:] == salt[:-1]))
    run = np.cumsum(new) - 1
    different = np.bincount(run, weights=~again)
    salted = salt >= 0
    with np.errstate(over="ignore"):
        first_of_token = np.maximum.accumulate(np.where(np.append(True, token[1:] != token[:-1]), np.arange(len(token)), 0))
        name = np.where(salted, token, scramble((token.view(np.uint64) + (run - run[first_of_token]).astype(np.uint64)), 2).view(np.int64))
    go = ~again & (salted | (different[run] > 1))
    return name[go], d1[go], size[go]


def near_edges(part: np.ndarray, run: np.ndarray, d1: np.ndarray, size: np.ndarray, percent: int, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """(d1, d1): edges that connect every two sets of a part which have fitting sizes and share as many runs as similar ones must.

    The sets of a run of more than ``dense`` are all connected; two that share no such run share only what is counted.
    """
    none = np.zeros(0, np.int64)
    if not len(part):
        return none, none
    by = np.lexsort((d1, size, part))  # so a set's partners among earlier sets are the smaller ones
    new = np.append(True, (part[by][1:] != part[by][:-1]) | (size[by][1:] != size[by][:-1]) | (d1[by][1:] != d1[by][:-1]))
    node = np.empty(len(by), np.int64)
    node[by] = np.cumsum(new) - 1
    own, n = d1[by][new], size[by][new]
    by = np.lexsort((node, run, part))
    held, group, token = node[by], part[by], run[by]
    first = np.append(True, (group[1:] != group[:-1]) | (token[1:] != token[:-1]))
    start = np.flatnonzero(first)
    sets = np.diff(np.append(start, len(held)))
    big = np.repeat(sets > dense, sets)
    a, b = own[held[np.repeat(start, sets)[big]]], own[held[big]]
    held, start = held[~big], np.repeat(np.cumsum(np.where(sets > dense, 0, sets)) - sets, sets)[~big]
    least = (n - -(-n * percent // 100) + 1) // 3 + 1
    small = -(-n * percent // 100)
    fewest = (small - -(-small * percent // 100) + 1) // 3 + 1
    at = np.argsort(held, kind="stable")
    ends = np.searchsorted(held[at], np.arange(len(n) + 1))
    label, up = np.arange(len(n)), list(range(len(n)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for k in np.flatnonzero(np.diff(ends) >= fewest).tolist():
        mine = at[ends[k] : ends[k + 1]]
        some = mine[mine > start[mine]]
        if len(some) < fewest[k]:
            continue
        met, shared = np.unique(np.concatenate([held[x:y] for x, y in zip(start[some].tolist(), some.tolist(), strict=True)]), return_counts=True)
        near = met[(shared >= least[met]) & (100 * n[met] >= percent * n[k])]
        for x in {top(x) for x in np.unique(label[near]).tolist()}:
            up[x] = k
        label[k] = k
    root = np.array([top(k) for k in range(len(n))])
    lowest = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(lowest, root, own)
    some = own != lowest[root]
    return np.append(a, own[some]), np.append(b, lowest[root][some])


def near_groups(met: DataFrame, groups: DataFrame, percent: int, listed: int = LISTED) -> DataFrame:
    """``node, component``: the sets of ``met`` (``run, d1, size``) that have one beside them which shares enough runs, grouped by such pairs.

    ``groups`` are the sets that runs hold together. A group of more than ``listed`` rows is cut by sizes that fit and, if
    that is not enough, into blocks that meet pairwise.
    """
    rows = cut(met.join(groups.withColumnsRenamed({"node": "d1", "component": "grp"}), "d1"), "grouped")
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"))
    wide = F.broadcast(counts.where(F.col("n") > listed).select("grp", F.lit(True).alias("wide")))  # at most a row for each ``listed`` rows
    band = F.floor(F.log("size") / (1.001 * max(np.log(100 / percent), 0.01))).cast("int")
    banded = rows.join(wide, "grp", "left").withColumn("band", F.explode(F.when(F.col("wide"), F.array(band, band + 1)).otherwise(F.array(F.lit(0)))))
    blocks = F.broadcast(banded.where("wide").groupBy("grp", "band").agg(F.ceil(F.count("*") / listed).cast("int").alias("blocks")).where("blocks > 1"))
    own = F.pmod(F.xxhash64("d1", "size"), F.coalesce("blocks", F.lit(1))).cast("int")
    met = banded.join(blocks, ["grp", "band"], "left").select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    part = F.xxhash64("grp", "band", F.least("own", "other"), F.greatest("own", "other")).alias("part")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (listed // 2) + 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[column(b, c).to_numpy() for c in ("part", "run", "d1", "size")] for b in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in near_edges(*(np.concatenate(x) for x in zip(*held, strict=True)), percent)], names=["a", "b"])

    found = components(map_batches(met.select(part, "run", "d1", "size").repartition(parts, "part"), find, "a long, b long"))
    drop(rows)
    return found


def linked_edges(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of indexes that connect what links among ``sets``; where ``side`` has both values, only pairs across count."""
    return links_among(sets, side, percent, sketch, len(set(side.tolist())) > 1, np.ones(len(sets), np.int64))[0]


class Postings:
    """Which sets have which tokens in their prefixes under one order, as flat arrays."""

    def __init__(self, prefixes: list[np.ndarray], tokens: int):
        token = np.concatenate(prefixes)
        by = np.argsort(token, kind="stable")  # sets come in ascending order, so those of a token do
        self.sets = np.repeat(np.arange(len(prefixes), dtype=np.int32), [len(p) for p in prefixes])[by]
        self.first = np.searchsorted(token[by], np.arange(tokens)).astype(np.int64)[token]
        self.own = np.empty(len(by), np.int64)
        self.own[by] = np.arange(len(by))
        self.end = np.cumsum([len(p) for p in prefixes])

    def before(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """From where to where the sets before ``r`` stand, for each of its prefix tokens that any of them has."""
        at = slice(self.end[r - 1] if r else 0, self.end[r])
        first, own = self.first[at], self.own[at]
        some = own > first
        return first[some], own[some]

    def met(self, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([self.sets[a:b] for a, b in zip(first.tolist(), own.tolist(), strict=True)]) if len(first) else self.sets[:0]


def links_among(sets: list[np.ndarray], side: np.ndarray, percent: int, sketch: np.ndarray, across: bool, rows: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(pairs of indexes that connect what links among ``sets``, the ``rows`` of all sets that each one links with).

    ``across``: only pairs whose ``side`` differs count.
    """
    links, edges = np.zeros(len(sets), np.int64), []
    if not sets:
        return edges, links
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    end = np.cumsum(size)
    numbers = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].astype(np.int32)
    tokens = int(numbers.max(initial=-1)) + 1
    mark, component, sides = np.zeros(tokens, np.uint8), np.arange(len(sets)), np.asarray(side)[order]
    keys = (lambda s: sketch[s % np.uint64(len(sketch))], lambda s: scramble(s, 2), lambda s: scramble(s, 3))
    first_of = lambda key, r: numbers[end[r] - size[r] : end[r]][np.argsort(key(sets[order[r]]), kind="stable")[: prefix_size(int(size[r]), percent)]]
    postings = [Postings([first_of(key, r) for r in range(len(sets))], tokens) for key in keys]
    seen = np.zeros(len(sets), bool)
    for r, i in enumerate(order.tolist()):
        fitting = int(np.searchsorted(100 * size[:r], percent * size[r]))
        where = postings[0].before(r)
        if not len(where[0]):
            continue
        if (where[1] - where[0]).sum() > 2 * (r - fitting):
            # Reading all sets of fitting size costs less than meeting most of them again and again.
            at, theirs = np.arange(fitting, r), numbers[end[fitting] - size[fitting] : end[r - 1]]
        else:
            at = np.unique(postings[0].met(*where)).astype(np.int64)
            at = at[at >= fitting]
            if across:
                at = at[sides[at] != sides[r]]
            for posting in postings[1:]:
                if len(at):
                    met = posting.met(*posting.before(r))
                    seen[met] = True
                    at, seen[met] = at[seen[at]], False
            if not len(at):
                continue
            theirs = np.concatenate([numbers[end[j] - size[j] : end[j]] for j in at.tolist()])
        if not len(at):
            continue
        own = numbers[end[r] - size[r] : end[r]]
        mark[own] = 1
        both = np.add.reduceat(mark[theirs], np.cumsum(size[at]) - size[at], dtype=np.int64)
        mark[own] = 0
        good = 100 * both >= percent * (size[r] + size[at] - both)
        if across:
            good &= sides[at] != sides[r]
        at = at[good]
        if len(at):
            links[i] += rows[order[at]].sum()
            links[order[at]] += rows[i]
            groups, first = np.unique(component[at], return_index=True)
            new = [(i, int(order[at[k]])) for k, c in zip(first.tolist(), groups.tolist(), strict=True) if c != component[r]]
            edges.extend(new)
            for c in groups.tolist():
                if c != component[r]:
                    if component[r] == r:
                        component[r] = c
                    else:
                        component[: r + 1][component[: r + 1] == c] = component[r]
    return edges, links


def similar_rows(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", counters: int = COUNTERS, block: int = BLOCK) -> DataFrame:
    """``id, t, size, class_id, component_id, n_links, first`` for each row of ``docs``, as ``similar_components`` says.

    ``t`` is the hash of the row's text. ``first`` marks the rows without n-grams and, of each component, the row of the
    smallest id (null is the largest) and among equal ids of the smallest ``t``; it marks all rows that share both.
    """
    spark = docs.sparkSession
    keyed = keyed_texts(docs, id_col, text)
    rows = cut(shingle_rows(keyed, words).withColumn("row", F.monotonically_increasing_id()), "shingles")
    base = rows.where("kind = 0").drop("kind")
    counted = rows.where("kind = 1").groupBy("id").agg(F.sum("size").alias("n")).toPandas()
    sketch = np.zeros(counters, np.int64)
    sketch[counted["id"].to_numpy(np.int64) % counters] = counted["n"].to_numpy(np.int64)
    sent, key = spark.sparkContext.broadcast(sketch.astype(np.uint32) if sketch.max(initial=0) < 1 << 32 else sketch), uuid.uuid4().hex

    heavy = max(1, int(sketch.sum()) // max(1, spark.sparkContext.defaultParallelism * 64))

    def prefixes(batch: pa.RecordBatch) -> dict:
        make, out = kept(key, Words), {"token": [], "salt": [], "d1": [], "size": []}
        for x in texts(batch):
            s = make.shingles(x, words)
            if len(s):
                mine = rare_first(s, sent.value)[: prefix_size(len(s), percent) + extra_size(len(s), percent)]
                d = _digest(s)[0]
                hot = sent.value[mine % np.uint64(len(sent.value))] > heavy
                for k, v in zip(out, (mine.view(np.int64), np.where(hot, d % SALTS, -1), np.full(len(mine), d), np.full(len(mine), len(s))), strict=True):
                    out[k].append(v)
        return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of some tokens: those that have a row of fitting size beside them, and what stands for a salted part."""
        held = [[column(b, c).to_numpy() for c in ("token", "salt", "d1", "size")] for b in batches]
        if not held:
            return
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in runs_of(*(np.concatenate(x) for x in zip(*held, strict=True)), percent)], names=["run", "d1", "size"])

    rows_out = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * (100 - percent) // 75
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows_out // MEETING + 1)
    firsts = map_rows(keyed.select("text"), prefixes, "token long, salt long, d1 long, size long", key).repartition(parts, "token", "salt")
    met = cut(map_batches(firsts, meet, "run long, d1 long, size long"), "met")
    shared = met.groupBy("run").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("run")
    all_met, met = met, cut(met.join(shared, "run"), "met")
    drop(all_met)
    n = F.col("size")
    smallest = F.ceil(n * percent / F.lit(100)).cast("long")
    least = ((smallest - F.ceil(smallest * percent / F.lit(100)) + 1) / 3).cast("long") + 1
    strong = met.groupBy("d1", "size").agg(F.countDistinct("run").alias("m")).where(F.col("m") >= least).select("d1")
    shared_met, met = met, cut(met.join(strong, "d1", "left_semi").select("run", "d1", "size").distinct(), "strong")
    drop(shared_met)
    stars = met.groupBy("run").agg(F.min("d1").alias("b"))
    groups = near_groups(met, components(met.join(stars, "run").select(F.col("d1").alias("a"), "b")), percent)
    # A class goes by the number of one of its rows, as ids may be null or repeated.
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("rep")
    classes = base.where("size > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), lowest, F.min("size").alias("size"), F.count("*").alias("rows"))
    candidates = classes.join(groups.withColumnsRenamed({"node": "d1", "component": "grp"}), "d1")
    weights = candidates.groupBy("grp").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"))
    candidates = cut(candidates.join(weights, "grp").withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int")), "candidates")
    wanted = candidates.select(F.coalesce("rep.id", F.lit(0)).alias("k"), F.col("rep.t").alias("t"), "grp", "node", "d1", "d2", "rows", "block", "blocks")
    whole = keyed.select(F.coalesce("id", F.lit(0)).alias("k"), "t", "text").join(small_side(wanted), ["k", "t"])
    schema = arrow_schema(T.StructType.fromDDL("grp long, node long, rows long, block int, blocks int, shingles binary"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A class's n-grams once for each partition, however many rows share its id and text."""
        seen: set[int] = set()
        for batch in batches:
            make, out = kept(key, Words), {f.name: [] for f in schema}
            for x, grp, node, d1, d2, n, at, blocks in zip(texts(batch), *(column(batch, c).to_pylist() for c in ("grp", "node", "d1", "d2", "rows", "block", "blocks")), strict=True):
                if node in seen:
                    continue
                s = make.shingles(x, words)
                if _digest(s) == (d1, d2):
                    seen.add(node)
                    for k, v in zip(out, (grp, node, n, at, blocks, s.tobytes()), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    sets = map_batches(whole, gather, "grp long, node long, rows long, block int, blocks int, shingles binary", key)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meets = sets.select("*", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        forget(key)
        pdf = pdf.drop_duplicates(["node"]).sort_values(["node"])
        found = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        nodes = pdf["node"].to_numpy()
        across = bool((pdf["lo"] != pdf["hi"]).any())  # even if one of the two blocks is empty: each block also meets itself
        edges, links = links_among(found, pdf["block"].to_numpy(), percent, sent.value, across, pdf["rows"].to_numpy(np.int64))
        some = np.flatnonzero(links)
        if sum(map(len, found)) > block // 4:
            trim()
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.append(nodes[ends[:, 0]], nodes[some]), "b": np.append(nodes[ends[:, 1]], nodes[some]), "n": np.append(np.zeros(len(ends), np.int64), links[some])}, dtype="int64")

    verified = cut(meets.groupBy("grp", "lo", "hi").applyInPandas(verify, "a long, b long, n long"), "verified")
    drop(met, candidates)
    linked = components(verified.where("a <> b").select("a", "b"))
    counts = verified.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    least = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").join(counts, "node").select("node", "least", "n")
    named = classes.join(linked, "node", "left").select("d1", "d2", "rep", F.coalesce("least", "rep").alias("least"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    found = base.join(named, ["d1", "d2"], "left")
    wordless = F.col("rep").isNull()
    return found.select(
        "id", "t", "size", F.when(wordless, F.col("id")).otherwise(F.col("rep.id")).alias("class_id"), F.when(wordless, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (wordless | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("t") == F.col("least.t")))).alias("first"),
    )


def similar_components(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", counters: int = COUNTERS, block: int = BLOCK) -> DataFrame:
    """``id_col, n_shingles, class_id, component_id, n_links`` for each row of ``docs``.

    ``n_shingles`` is the size of the text's set of distinct ``words``-grams; ``class_id`` the smallest id with the same set;
    ``component_id`` the smallest id that links of at least ``percent`` per cent Jaccard similarity lead to, itself included;
    ``n_links`` the number of other rows that the row itself links with, those with the same set among them.
    A text of fewer words has one n-gram, its whole sequence; null, empty and wordless texts have none and link with nothing.
    Every row is a document of its own, whatever its id: rows that share an id are linked by their texts only, and a row
    whose id is null is joined like any other. Null counts as larger than any id, so ``class_id`` and ``component_id`` are
    null only where no row of the class or component has an id. Very long texts are taken whole; an empty table gives none;
    further columns of ``docs`` are not read. Ids are whole numbers.
    """
    found = similar_rows(docs, words=words, percent=percent, id_col=id_col, text=text, counters=counters, block=block)
    named = lambda c: F.col(c).cast(docs.schema[id_col].dataType)
    return found.select(named("id").alias(id_col), F.col("size").alias("n_shingles"), named("class_id").alias("class_id"), named("component_id").alias("component_id"), "n_links")
