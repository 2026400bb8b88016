"""Duplicated passages by suffix arrays.

Texts are byte strings. A passage is a string of ``length`` bytes that starts at more than one place, in one text or several.
Every such string holds an anchor: the place of the least hash among its ``KGRAM``-byte windows. Equal strings hold equal
anchors, so only what surrounds an anchor whose window occurs again can be duplicated. Anchors are counted in Spark with the
hash of their surroundings; where all surroundings of an anchor are equal, every string through it is duplicated. The others'
surroundings meet by anchor in blocks, and each block is settled by its suffix array: two-stage sorting, then the common
prefixes of adjacent suffixes. Anchors with more surroundings than a block takes are told apart by more of the bytes around
them, again and again, until each part fits: every string goes through a suffix array, however often its passage occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import arrow_schema, column, cut, drop, forget, map_batches

KGRAM = 24
#: Bytes of surroundings that a block takes; an anchor with more is split by the bytes around it.
BLOCK = 1 << 19
#: Odd multipliers of the rolling and mixing hashes (fixed values).
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---------------------------------------------------------------- two-stage suffix sorting


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors (the suffix after the last is the empty, smallest one)."""
    n = len(s)
    up = np.zeros(n, bool)
    if n < 2:
        return up
    # Within a run of equal symbols all suffixes are alike: what follows the run decides.
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    known = nxt < n
    up[:-1][known] = step[nxt[known]] > 0
    return up


def words8(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that orders like them; zeros follow the last byte."""
    held = np.concatenate([s, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((len(s) + 1,), ">u8", held, strides=(1,)).astype(np.uint64)


def sort_directly(s: np.ndarray, which: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes of the bytes ``s`` at ``which``, in order of their first ``depth`` bytes (None: of all).

    Each round compares the bytes that a number has room for beside its group's number, of ties alone; ties whose rest up to
    ``depth`` has one hash are done.
    """
    packed, n = words8(s), len(s)
    sums = rolling_sums(s) if depth else None
    order = np.array(which, np.int64)
    # ``todo``: places of ``order`` that are not settled, by group; ``group``: their groups' numbers, from 0.
    todo, group, at = np.arange(len(order)), np.zeros(len(order), np.uint64), 0
    while len(todo) and (depth is None or at < depth):
        bits = int(group[-1]).bit_length()
        width = (64 - bits) // 8
        here = order[todo]
        key = packed[np.minimum(here + at, n)] >> np.uint64(64 - 8 * width)
        if bits:
            key |= group << np.uint64(8 * width)
        by = np.argsort(key) if depth else np.lexsort((n - here, key))
        here, key = here[by], key[by]
        order[todo] = here
        over = here + at + width > n  # the text's end: a shorter suffix is the smaller one, and none has its length
        new = np.ones(len(todo), bool)
        new[1:] = (key[1:] != key[:-1]) | over[1:] | over[:-1]
        at += width
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(todo)))
        tied = size > 1
        if sums is not None and at >= 16 and tied.any():
            held = np.flatnonzero(np.repeat(tied, size))  # only ties are hashed
            rest = window_hash(sums, np.minimum(here[held] + at, n), np.minimum(here[held] + depth, n))
            ends = np.cumsum(size[tied]) - size[tied]
            tied[tied] = np.maximum.reduceat(rest, ends) != np.minimum.reduceat(rest, ends)
        todo = todo[np.repeat(tied, size)]
        group = np.repeat(np.arange(int(tied.sum()), dtype=np.uint64), size[tied])
    return order


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The starts of all suffixes of the bytes ``s``, in order of their first ``depth`` bytes (None: of all), by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. Every other suffix stands in the front part of its symbol's
    bucket, and its place follows from its successor's: buckets are scanned upwards, and what stands before a scanned
    suffix and isn't smaller than it is put in the next free place at the front of its own bucket.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    up = smaller_than_next(s)
    total = np.bincount(s, minlength=256)
    head = np.cumsum(total) - total
    sa = np.full(n, -1, np.int64)
    small = sort_directly(s, np.flatnonzero(up), depth)
    # In order of the first bytes: so in order of the symbols, too.
    ups = np.bincount(s[small], minlength=256)
    tail, at = head + total - ups, np.cumsum(ups) - ups
    sa[tail[s[small]] + np.arange(len(small)) - at[s[small]]] = small
    free = head.copy()

    def place(found: np.ndarray) -> np.ndarray:
        """Put each suffix of ``found``, in order, in the next free place of its bucket; returns their places."""
        symbol = s[found]
        by = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[by]
        first = np.searchsorted(sorted_symbol, sorted_symbol)
        places = np.empty(len(found), np.int64)
        places[by] = free[sorted_symbol] + np.arange(len(found)) - first
        sa[places] = found
        counts = np.bincount(symbol, minlength=256)
        free[:] += counts
        return places

    place(np.array([n - 1]))  # the last suffix is larger than the empty one
    for c in np.flatnonzero(total).tolist():
        lo = head[c]
        while lo < free[c]:  # suffixes of this bucket may put more at its front
            hi = free[c]
            before = sa[lo:hi] - 1
            before = before[before >= 0]
            place(before[~up[before]])
            lo = hi
        before = sa[tail[c] : head[c] + total[c]] - 1
        before = before[before >= 0]
        if len(before):
            place(before[~up[before]])
    return sa


def adjacent_prefixes_reach(s: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each i, whether suffixes sa[i] and sa[i+1] have a common prefix of ``length`` bytes: eight compared at a time."""
    n = len(s)
    out = np.zeros(max(n - 1, 0), bool)
    if n < 2:
        return out
    a, b, packed = sa[:-1], sa[1:], words8(s)
    live = np.flatnonzero((a + length <= n) & (b + length <= n))
    for k in range(0, length - 7, 8):
        live = live[packed[a[live] + k] == packed[b[live] + k]]
    for k in range(length - length % 8, length):
        live = live[s[a[live] + k] == s[b[live] + k]]
    out[live] = True
    return out


END = 255  # no byte of UTF-8 text


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part (no byte 255 in it), the starts of its strings of ``length`` bytes that start elsewhere too, in any part."""
    if not parts:
        return []
    s = np.frombuffer(bytes([END]).join([*parts, b""]), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    offset = np.cumsum(sizes + 1) - sizes - 1
    sa = suffix_array(s, length)
    same = adjacent_prefixes_reach(s, sa, length)
    hit = np.zeros(len(s), bool)
    hit[sa[1:][same]] = True
    hit[sa[:-1][same]] = True
    return [np.flatnonzero(hit[o : o + max(n - length + 1, 0)]) for o, n in zip(offset, sizes, strict=True)]


# ---------------------------------------------------------------- hashes of windows


class Powers:
    """Powers of the rolling hash's base and of its inverse, and a number for each byte; grown as needed."""

    up = down = np.ones(1, np.uint64)
    inverse = np.uint64(pow(int(ROLL), -1, 1 << 64))
    of_byte = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            grow = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            cls.up, cls.down = grow(ROLL), grow(cls.inverse)
        return cls.up, cls.down


def rolling_sums(s: np.ndarray) -> np.ndarray:
    """Sums whose differences, shifted back, are hashes of windows (arithmetic modulo 2 ** 64)."""
    up, _ = Powers.upto(len(s) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(Powers.of_byte[s] * up[: len(s)])])


def window_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    x = (sums[hi] - sums[lo]) * Powers.upto(len(sums))[1][lo]
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(27))


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` numbers in a row."""
    n = len(x)
    full = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    forward = np.minimum.accumulate(full, axis=1).ravel()
    backward = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchors(parts: list[bytes], length: int, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(part, from, to, place, hash of the anchor, hash of its surroundings) of every anchor of some byte strings, 64 MiB at most.

    The surroundings are the bytes of the strings whose anchor it is; these start at one place after another.
    """
    long = [i for i, p in enumerate(parts) if len(p) >= length]
    none = np.zeros(0, np.int64)
    if not long:
        return none, none, none, none, none, none
    s = np.frombuffer(b"".join(parts[i] for i in long), np.uint8)
    size = np.array([len(parts[i]) for i in long], np.int64)
    end = np.cumsum(size)
    sums, n, w = rolling_sums(s), len(s), length - k + 1
    at = np.arange(n - k + 1)
    gram = window_hash(sums, at, at + k)
    low = np.uint64((1 << 26) - 1)
    found = least_in_windows((gram & ~low) | at.astype(np.uint64), w) & low  # the least hash, the leftmost of equal ones
    inside = np.ones(n - length + 1, bool)
    for e in end[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False  # such strings would cross the end of a part
    starts = np.flatnonzero(inside)
    place = found[starts].astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # from one string to the next an anchor only moves on
    lo, hi, place = starts[new], starts[np.append(new[1:], len(starts)) - 1] + length, place[new]
    part = np.searchsorted(end, place, side="right")
    around = window_hash(sums, lo, hi) + ((place - lo) * 1024 + (hi - place)).astype(np.uint64) * MIX
    origin = end[part] - size[part]
    return np.asarray(long)[part], lo - origin, hi - origin, place - origin, gram[place].view(np.int64), around.view(np.int64)


# ---------------------------------------------------------------- Spark


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings of ``length`` bytes at sorted ``starts`` cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), (starts[np.concatenate([cuts, [len(starts) - 1]])] + length).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


CHUNK, PIECE = 1 << 18, 1 << 20


def _chunks(data: list[bytes], length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(index of the text, offset in it, bytes) of runs of up to 256 KB together.

    Longer texts are cut into pieces of ``piece`` bytes that overlap by ``length`` - 1 bytes: each string of ``length`` bytes starts in one.
    """
    rows, offsets, parts, size = [], [], [], 0
    for i, x in enumerate(data):
        for at in range(0, max(len(x) - length + 1, 1), piece):
            part = x[at : at + piece + length - 1]
            if size and size + len(part) > CHUNK:
                yield np.array(rows), np.array(offsets), parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(rows), np.array(offsets), parts


def _map(df: DataFrame, run, ddl: str, more: list[T.StructField] | None = None) -> DataFrame:
    struct = T.StructType([*T.StructType.fromDDL(ddl), *(more or [])])
    schema = arrow_schema(struct)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for cols in run(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return map_batches(df, batches, struct)


def settled_runs(regions: DataFrame, length: int, block: int) -> DataFrame:
    """``h, around, from, to``: the bytes of each region (``h, around, n, at, region, size``) that duplicated strings cover.

    Regions meet by their anchor ``h`` in blocks, which suffix arrays settle; a region that stands at ``n`` > 1 places is
    duplicated as a whole. An anchor with more than ``block`` bytes of regions is split first.
    """
    per_anchor = regions.groupBy("h").agg(F.sum("size").alias("bytes"))
    wide = per_anchor.where(F.col("bytes") > block).select("h")
    total = per_anchor.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    narrow = regions.join(wide, "h", "left_anti").select(F.col("h").alias("g"), F.col("around").alias("r"), "n", "region")
    split = split_regions(regions.join(wide, "h", "left_semi"), length, block)
    if split is not None:
        narrow = narrow.unionByName(split.groupBy("g", "r").agg(F.sum("n").alias("n"), F.first("region").alias("region")))
    dealt = narrow.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(max(1, int(total) // block + 1))))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        pdf = pdf.sort_values(["g", "r"])
        found, data = [], pdf["region"].tolist()
        for starts, region, n in zip(repeated_starts(data, length), data, pdf["n"], strict=True):
            runs = [(0, len(region))] if n > 1 else covered(starts, length)
            found.append([{"from": a, "to": b} for a, b in runs])
        return pd.DataFrame({"g": pdf["g"], "r": pdf["r"], "runs": found})

    settled = dealt.groupBy("block").applyInPandas(settle, "g long, r long, runs array<struct<from:int,to:int>>")
    settled = settled.select("g", "r", F.explode("runs").alias("run")).select("g", "r", "run.from", "run.to")
    if split is None:
        return settled.withColumnsRenamed({"g": "h", "r": "around"})
    settled = cut(settled, "settled")
    whole = settled.join(wide, settled["g"] == wide["h"], "left_anti").withColumnsRenamed({"g": "h", "r": "around"})
    return whole.unionByName(settled.join(split.drop("n", "region"), ["g", "r"]).select("h", "around", (F.col("from") + F.col("shift")).cast("int").alias("from"), (F.col("to") + F.col("shift")).cast("int").alias("to")))


def split_regions(regions: DataFrame, length: int, block: int) -> DataFrame | None:
    """``h, around, shift, g, r, n, region``: parts of the regions, from byte ``shift`` on, that meet by ``g`` in groups that fit; None if there are none.

    Strings that are equal have their anchor at the same byte. Those that have it at bytes ``a`` to ``b`` share the bytes
    around it which all of them reach, so strings of ``a`` to ``b`` can only equal strings with the same such core. A group
    that is too large is halved, ``a`` to the middle and from there to ``b``: its cores grow until a group is one string.
    """
    todo = cut(regions.select("h", "around", F.lit(0).alias("shift"), "n", "at", "region", F.col("h").alias("g"), F.lit(0).alias("a"), F.lit(length - KGRAM).alias("b"), F.col("around").alias("r")), "split")
    done: list[DataFrame] = []
    names = ["h", "around", "shift", "g", "r", "n", "region"]
    while todo.limit(1).count():
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))).alias("half")
        a, b, at = F.col("half.a"), F.col("half.b"), F.col("at")
        lo, hi = F.greatest(at - b, F.lit(0)), F.least(at - a + length, F.octet_length("region"))
        parts = todo.select("*", halves).where((a <= b) & (hi - lo >= length))
        core, own = F.substring("region", at - a + 1, length - (b - a)), F.substring("region", lo + 1, hi - lo)
        parts = parts.select("h", "around", (F.col("shift") + lo).alias("shift"), "n", (at - lo).alias("at"), own.alias("region"), F.xxhash64("g", a, core).alias("g"), a.alias("a"), b.alias("b"), F.xxhash64(at - lo, own).alias("r"))
        parts = cut(parts, "split")
        sizes = parts.groupBy("g", "r", "a", "b").agg(F.first(F.octet_length("region")).alias("size")).groupBy("g", "a", "b").agg(F.sum("size").alias("bytes"))
        wide = sizes.where((F.col("bytes") > block) & (F.col("a") < F.col("b"))).select("g")
        done.append(parts.join(wide, "g", "left_anti").select(*names))
        todo = cut(parts.join(wide, "g", "left_semi"), "split")
    if not done:
        return None
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return cut(found, "parts")


def duplicate_spans(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, piece: int = PIECE, keep: list[str] | None = None) -> DataFrame:
    """``id, t, text, marks, more``: each row's duplicated byte runs as sorted, disjoint ``struct<start:bigint,end:bigint>``.

    ``id`` is the row's id and ``t`` a hash of its text. Rows that repeat are texts of their own, so their whole text is
    duplicated if it has ``length`` bytes. Null texts count as empty. ``more`` holds the row's columns ``keep``, if asked for.
    """
    if length < 2 * KGRAM:
        raise ValueError(f"passages must have {2 * KGRAM} bytes or more")
    more = [F.struct(*keep).alias("more")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more).withColumn("t", F.xxhash64("text"))
    keyed = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("k"), "t", "text").where(F.octet_length("text") >= length)

    def find(batch: pa.RecordBatch) -> Iterator[dict]:
        data = [x.encode() for x in column(batch, "text").to_pylist()]
        k, t = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("k", "t"))
        for rows, offsets, parts in _chunks(data, length, piece):
            i, lo, hi, place, h, around = anchors(parts, length)
            yield {"k": k[rows[i]], "t": t[rows[i]], "lo": lo + offsets[i], "hi": hi + offsets[i], "at": place - lo, "h": h, "around": around}

    places = cut(_map(keyed, find, "k long, t long, lo long, hi long, at int, h long, around long"), "anchors")
    again = cut(places.groupBy("h").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where("n > 1").select("h", F.expr("a <> b").alias("mixed")), "again")
    met = cut(places.join(again, "h"), "met")
    drop(places, again)
    sure = met.where("not mixed").select("k", "t", "lo", "hi")

    flagged = met.where("mixed").groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi", "at", "h", "around")).alias("found"))
    with_text = keyed.join(flagged, ["k", "t"])

    def surroundings(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict = {"h": [], "around": [], "at": [], "region": []}
        for x, found in zip(column(batch, "text").to_pylist(), column(batch, "found").to_pylist(), strict=True):
            data = x.encode()
            for one in found:
                for name, v in zip(out, (one["h"], one["around"], one["at"], data[one["lo"] : one["hi"]]), strict=True):
                    out[name].append(v)
        yield out

    regions = _map(with_text, surroundings, "h long, around long, at int, region binary")
    regions = cut(regions.groupBy("h", "around").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("region").alias("region")).withColumn("size", F.octet_length("region")), "regions")
    runs = cut(settled_runs(regions, length, block), "runs")
    drop(regions)
    settled_marks = met.where("mixed").join(runs, ["h", "around"]).select("k", "t", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    marks = sure.unionByName(settled_marks).groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    joined = rows.withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(-1))).join(marks, ["k", "t"], "left")
    return joined.select("id", "t", "text", F.coalesce("marks", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("marks"), *(["more"] if keep else []))


def remove_duplicates(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, piece: int = PIECE, keep: list[str] | None = None) -> DataFrame:
    """``id_col, n_bytes, spans, kept`` and the columns ``keep`` for each row of ``docs``: its duplicated byte runs, and the bytes outside them.

    A byte goes if a string of ``length`` bytes over it also starts at another place of any text, its own included; strings
    are judged on the input. Null texts count as empty; texts shorter than ``length`` keep every byte; rows that repeat
    count as texts of their own, whether their ids are null, equal or not. An empty table gives none; further columns are
    not read. Ids are whole numbers.
    """

    def apply(batch: pa.RecordBatch) -> Iterator[dict]:
        spans, kept, sizes = [], [], []
        for x, marks in zip(column(batch, "text").to_pylist(), column(batch, "marks").to_pylist(), strict=True):
            data = x.encode()
            runs = merged([(m["lo"], min(m["hi"], len(data))) for m in marks])
            at = [0, *(e for _, e in runs)], [*(b for b, _ in runs), len(data)]
            spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(*at, strict=True)))
            sizes.append(len(data))
        more = column(batch, "more") if keep else None
        yield {id_col: column(batch, "id"), "n_bytes": sizes, "spans": spans, "kept": kept} | {c: more.field(c) for c in keep or ()}

    found = duplicate_spans(docs, length=length, id_col=id_col, text=text, block=block, piece=piece, keep=keep)
    return _map(found, apply, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary", [docs.schema[c] for c in keep or ()])
