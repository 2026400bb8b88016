"""Packing documents into sequences by cutting-stock column generation.

Documents are cut into full sequences and a rest. The rests' lengths, rounded up to classes, form a histogram. A linear
program covers it with patterns (which classes stand in one sequence); patterns are found by a knapsack dynamic program that
prices them with the program's dual values. Rounded patterns get the ranked documents of each class.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import Cache, column, cut, kept, map_rows, texts

#: Tokens of a sequence, tokens of a length class, and the share by which the program may miss its bound.
LENGTH, STEP, GAP = 2048, 8, 1e-3
#: Steps of the linear program for each class at most; every step leaves a cover that can be used.
STEPS = 8
#: Pieces that are ranked together, rows up to which a table is broadcast, and cached words of a worker.
RANKED, SMALL, CACHED = 50_000, 100_000, 300_000


# ---------------------------------------------------------------- tokens


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """White-space separated chunk to its token ids (packed little-endian), as the library gives them for whole texts.

    The vocabulary's own steps (fold white space, lower-case, split words) never look across white space, so a text's ids are
    its chunks' ids in a row. A chunk of plain Latin letters, digits and signs is split here and its words go to the library's
    model; any other chunk goes through the whole library.
    """

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.model, self.letters = self.whole.model, byte_letters()
        self.chunks = Cache(self.chunk, CACHED, 48)

    def chunk(self, chunk: str) -> bytes:
        """A word of a chunk is a chunk itself, with the same ids: one cache holds both."""
        if not chunk:
            return b""
        if chunk.isprintable() and max(chunk) < "ɐ" and "<|" not in chunk:
            words = self.WORDS.findall(chunk.lower())
            if words == [chunk]:
                return self.word(chunk)
            return b"".join([self.chunks[w] if max(w) < "ɐ" else self.word(w) for w in words])
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def text(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, vocabulary_path: str, *, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, copy, start, length, ids_crc32, doc_tokens``: each text's ids and the end id, cut into full pieces and a rest.

    ``copy`` tells rows of one id apart by their ids' crc32.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        sent, key = docs.sparkSession.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    end = np.array([end_id], "<u4").tobytes()

    def per_batch(batch: pa.RecordBatch) -> dict:
        ids = kept(key, lambda: WordIds(sent.value))
        out = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens")}
        for one, x in zip(column(batch, "id").to_pylist(), texts(batch, text), strict=True):
            packed = memoryview(ids.text(x) + end)
            total = len(packed) // 4
            for at in range(0, total, length):
                part = packed[4 * at : 4 * (at + length)]
                for k, v in zip(out, (one, at, len(part) // 4, zlib.crc32(part), total), strict=True):
                    out[k].append(v)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), text), per_batch, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long", key)


# ---------------------------------------------------------------- the plan


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, Counter]:
    """The most valuable multiset of classes that fits: an unbounded knapsack over capacities."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    by = np.argsort(size, kind="stable")
    sizes, values = size[by], value[by]
    for c in range(1, room + 1):
        fit = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if fit:
            v = values[:fit] + best[c - sizes[:fit]]
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], by[k]
    pattern, c = Counter(), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[int(took[c])] += 1
            c -= int(size[took[c]])
    return float(best[room]), pattern


def solve(size: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[Counter, float]]:
    """Patterns and how often each is used, of the linear program that covers ``demand`` with the fewest sequences.

    Revised simplex: the basis starts with each class alone; a priced pattern enters until the uses are within ``gap`` of a
    lower bound (the tokens' own, or the one that the dual values prove).
    """
    n = len(size)
    columns = [Counter({i: int(room // size[i])}) for i in range(n)]
    inverse = np.diag(1.0 / (room // size).astype(float))
    # Demands a little apart keep the program from stepping in place.
    demand = demand * (1 + 1e-4 * np.linspace(0, 1, n))
    times = lambda m, v: np.einsum("ij,j->i", m, v)  # noqa: E731  on one thread, unlike a product
    used = times(inverse, demand)
    bound = float((size * demand).sum()) / room  # tokens alone need so many sequences
    for _ in range(STEPS * n):
        dual = inverse.sum(axis=0)
        best, pattern = best_pattern(np.maximum(dual, 0), size, room)
        bound = max(bound, used.sum() / max(best, 1))
        if best <= 1 + 1e-9 or used.sum() <= bound * (1 + gap):
            break
        entering = np.zeros(n)
        for k, v in pattern.items():
            entering[k] = v
        change = times(inverse, entering)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount = ratio[out]
        used -= amount * change
        used[out] = amount
        pivot = inverse[out] / change[out]
        inverse -= change[:, None] * pivot
        inverse[out] = pivot
        columns[out] = pattern
    return [(p, float(u)) for p, u in zip(columns, np.maximum(used, 0), strict=True) if u > 1e-9]


def plan(histogram: dict[int, int], room: int) -> list[tuple[Counter, int]]:
    """Whole patterns over class sizes, and how many sequences have each; exactly the histogram's pieces get a place.

    The program's uses are rounded down; what they leave over is placed first-fit, the largest first.
    """
    sizes = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(k)] for k in sizes], np.int64)
    out: list[tuple[Counter, int]] = []
    for pattern, use in sorted(solve(sizes, left.astype(float), room), key=lambda x: -x[1]):
        whole = min([int(use + 1e-3), *(int(left[k]) // v for k, v in pattern.items())])
        if whole > 0:
            out.append((Counter({int(sizes[k]): v for k, v in pattern.items()}), whole))
            for k, v in pattern.items():
                left[k] -= v * whole
    # What is left: fill one sequence at a time with the largest that fit, as often as all of it can be repeated.
    while left.sum():
        space, pattern = room, Counter()
        for k in range(len(sizes) - 1, -1, -1):
            take = min(int(left[k]), space // int(sizes[k]))
            if take:
                pattern[k] += take
                space -= take * int(sizes[k])
        times = max(1, min(int(left[k]) // v for k, v in pattern.items()))
        out.append((Counter({int(sizes[k]): v for k, v in pattern.items()}), times))
        for k, v in pattern.items():
            left[k] -= v * times
    return out


def slots(patterns: list[tuple[Counter, int]], first: int) -> pd.DataFrame:
    """For each class: which ranks stand in which sequences. A row gives ranks ``lo`` to ``lo + each * times``, ``each`` a sequence."""
    rows, taken = [], Counter()
    for pattern, times in patterns:
        for size, each in sorted(pattern.items(), reverse=True):
            rows.append((size, taken[size], each, first, size))
            taken[size] += each * times
        first += times
    return pd.DataFrame(rows, columns=["cls", "lo", "each", "base", "place"]).astype("int64")


def pack(docs: DataFrame, vocabulary_path: str, *, length: int = LENGTH, step: int = STEP, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its text's ids and ``end_id``; null and empty texts are the end id alone. Full pieces fill a sequence each;
    rests share sequences of at most ``length`` tokens, gapless from offset 0, in order of decreasing class, then rank. Repeated
    rows are packed each for itself; an empty table gives none; further columns are not read. Equal input gives
    an equal packing, however it is partitioned.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, vocabulary_path, end_id=end_id, length=length, id_col=id_col, text=text), "pieces")
    room = length // step
    cls = F.ceil(F.col("length") / step).cast("long")
    histogram = {r[0]: r[1] for r in found.groupBy(cls.alias("cls")).count().collect()}  # a row for each of the classes
    # A class is ranked in parts of about RANKED pieces, however many it has: most pieces of long texts are of the largest class.
    parts = {c: -(-n // RANKED) for c, n in histogram.items()}
    part = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.create_map(*[F.lit(x) for c, n in sorted(parts.items()) for x in (c, n)])[F.col("cls")]) if parts else F.lit(0).cast("long")
    ranked = found.withColumn("cls", cls).withColumn("part", part)
    counts = ranked.groupBy("cls", "part").agg(F.count("*").alias("n"))
    before = counts.select("cls", "part", (F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("cls", "part").orderBy("id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = ranked.withColumn("own", own).join(F.broadcast(before) if sum(parts.values()) <= SMALL else before, ["cls", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    table = slots(plan(histogram, room), 0)
    sent, key = spark.sparkContext.broadcast({c: g.sort_values("lo")[["lo", "each", "base"]].to_numpy() for c, g in table.groupby("cls")}), uuid.uuid4().hex
    names = ("id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank")

    def assign(batch: pa.RecordBatch) -> dict:
        plans = kept(key, lambda: sent.value)
        cls, rank = column(batch, "cls").to_numpy(), column(batch, "rank").to_numpy()
        sequence = np.zeros(len(cls), np.int64)
        for c in np.unique(cls):
            at, rows = np.flatnonzero(cls == c), plans[int(c)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            sequence[at] = row[:, 2] + (rank[at] - row[:, 0]) // row[:, 1]
        return {n: column(batch, n) for n in names} | {"sequence_id": sequence}

    kind = docs.schema[id_col].dataType.simpleString()
    placed = map_rows(ranked.select(*names), assign, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls long, rank long, sequence_id long", key)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    offset = (F.sum("length").over(inside) - F.col("length")).alias("offset")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
