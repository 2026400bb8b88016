"""The columnar record format: batches of columns that index whole frames, each with a footer that can be read alone.

A file is a header and batches: body length, body, footer. A body is blocks, one for each column that holds anything: id,
codec, raw length, stored length, bytes. Numbers are varints, differences zigzag-coded; absence is a bit of a mask. Columns
are read and written whole, as arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BufferedIOBase

import numpy as np

from seqlake.functions.bits import crc32c
from seqlake.functions.frames import decode
from seqlake.sources.records import GAP, MESSAGE, RESEED, Record, exact

#: Fixed values of the format: its version, the footer's mark and layout, flags, limits, codecs, and the columns' numbers.
VERSION, MARK, FOOTER, HAS_GAP, HAS_RESEED = 2, b"TAPB", struct.Struct("<4sHHIqqIII"), 1, 2
MOST_BODY, MOST_ROWS, STORED, DEFLATED, LEVEL = 64 << 20, 1 << 20, 0, 1, 8
COLUMNS = [
    "kind", "recv", "exchange.mask", "exchange", "sequence.mask", "sequence", "side.mask", "side.sell", "side.text", "price.mask", "price.scale", "price", "price.text",
    "size.mask", "size.scale", "size", "size.text", "type", "gap", "reseed", "frames", "dropped",
]
NUMBER = {name: i for i, name in enumerate(COLUMNS, 1)}
#: A batch closes before a record this much later than its first, and after so many rows or bytes of frames.
AGE_NS, ROWS, BYTES = 30_000_000_000, 4096, 4 << 20


class Corrupt(ValueError):
    """The bytes are no batch, or contradict themselves."""


@dataclass(frozen=True)
class Footer:
    flags: int
    rows: int
    first_ns: int
    last_ns: int
    body: int
    crc: int

    @property
    def has_gap(self) -> bool:
        return bool(self.flags & HAS_GAP)

    @property
    def has_reseed(self) -> bool:
        return bool(self.flags & HAS_RESEED)

    def packed(self) -> bytes:
        head = FOOTER.pack(MARK, VERSION, self.flags, self.rows, self.first_ns, self.last_ns, self.body, self.crc, 0)[:-4]
        return head + struct.pack("<I", crc32c(head))

    @classmethod
    def unpack(cls, data: bytes) -> Footer:
        if len(data) != FOOTER.size or data[:4] != MARK:
            raise Corrupt("no footer")
        _, version, flags, rows, first, last, body, crc, own = FOOTER.unpack(data)
        if crc32c(data[:-4]) != own:
            raise Corrupt("the footer fails its checksum")
        if version != VERSION or rows > MOST_ROWS:
            raise Corrupt(f"a footer of version {version} with {rows} rows")
        return cls(flags, rows, first, last, body, crc)


# ---------------------------------------------------------------- numbers


def to_varints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, seven bits a byte, the least first."""
    v = np.asarray(values, np.uint64)
    groups = v[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))
    used = np.maximum((groups > 0).sum(1), 1)
    inside = np.arange(10) < used[:, None]
    last = np.arange(10) == used[:, None] - 1
    return ((groups & np.uint64(127)).astype(np.uint8) | np.where(last, 0, 128).astype(np.uint8))[inside].tobytes()


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    if len(b) and (not len(end) or end[-1] != len(b) - 1):
        raise Corrupt("a number is cut off")
    if not len(end):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, end - first + 1)
    if place.max() > 9 or (b[place == 9] > 1).any():
        raise Corrupt("a number has more than 64 bits")
    return np.add.reduceat((b & 127).astype(np.uint64) << (place * 7).astype(np.uint64), first)


def zigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return (v.view(np.uint64) << np.uint64(1)) ^ (v >> np.int64(63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.uint64)
    return ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64)


def steps(values: list[int]) -> bytes:
    """Differences from one to the next, the first from 0, as 64 bits hold them."""
    v = np.array([x & ((1 << 64) - 1) for x in values], np.uint64)
    return to_varints(zigzag((v - np.concatenate([np.zeros(1, np.uint64), v[:-1]])).view(np.int64))) if values else b""


def summed(data: bytes) -> np.ndarray:
    return np.cumsum(unzigzag(from_varints(data)).view(np.uint64)).view(np.int64)


def varint(n: int) -> bytes:
    """One number; far cheaper than an array of one."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


class Walk:
    """Numbers and runs of bytes, one after another; everything must be used up in the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        value = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise Corrupt("a number is cut off")
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def run(self) -> bytes:
        n = self.number()
        if n > len(self.data) - self.at:
            raise Corrupt("a run of bytes is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def runs(self) -> list[bytes]:
        out = []
        while self.at < len(self.data):
            out.append(self.run())
        return out

    def sparse(self, value) -> dict:
        """Row to value, where few rows have one: their count, then (rows since the last one, value) each."""
        if not self.data:
            return {}
        n, row, out = self.number(), 0, {}
        if n > len(self.data) // 2:
            raise Corrupt(f"{n} values in {len(self.data)} bytes")
        for _ in range(n):
            row += self.number()
            out[row] = value(self)
        self.done()
        return out

    def done(self) -> None:
        if self.at != len(self.data):
            raise Corrupt(f"{len(self.data) - self.at} bytes are left over")


def packed_runs(runs: list[bytes]) -> bytes:
    return b"".join(varint(len(x)) + x for x in runs)


def packed_sparse(found: dict[int, bytes]) -> bytes:
    rows = sorted(found)
    return varint(len(rows)) + b"".join(varint(r - p) + found[r] for p, r in zip([0, *rows], rows, strict=False)) if rows else b""


# ---------------------------------------------------------------- blocks and batches


def block(number: int, data: bytes) -> bytes:
    """A column's block, deflated where that is smaller; none for an empty column."""
    if not data:
        return b""
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    small = squeeze.compress(data) + squeeze.flush()
    codec, stored = (DEFLATED, small) if len(small) < len(data) else (STORED, data)
    return bytes([number, codec]) + varint(len(data)) + varint(len(stored)) + stored


def walk_blocks(body: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, codec, raw length, stored bytes) of each block; nothing is inflated."""
    walk, seen = Walk(body), set()
    while walk.at < len(body):
        if walk.at + 2 > len(body):
            raise Corrupt("a block is cut off")
        number, codec = body[walk.at], body[walk.at + 1]
        walk.at += 2
        raw = walk.number()
        stored = walk.run()
        if raw > MOST_BODY or codec not in (STORED, DEFLATED) or codec == STORED and raw != len(stored):
            raise Corrupt(f"block {number} has codec {codec}, {raw} bytes in {len(stored)}")
        if number in seen:
            raise Corrupt(f"column {number} stands there twice")
        seen.add(number)
        yield number, codec, raw, stored


def inflated(codec: int, raw: int, stored: bytes) -> bytes:
    if codec == STORED:
        return stored
    try:
        grow = zlib.decompressobj(-15)
        data = grow.decompress(stored, raw + 1)
    except zlib.error as e:
        raise Corrupt(str(e)) from None
    if len(data) != raw or not grow.eof:
        raise Corrupt(f"a block of {raw} bytes inflates to others")
    return data


def mask(flags: list[bool]) -> bytes:
    return np.packbits(np.array(flags, bool), bitorder="little").tobytes() if any(flags) else b""


def unmask(data: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)
    return np.concatenate([bits, np.zeros(n - len(bits), bool)])


def decimals(texts: list[str], chained: bool) -> tuple[bytes, bytes, dict[int, str]]:
    """(scales, units, texts that are no exact decimals by place among the present ones) of a price or size column."""
    scales, units, odd, last = [], [], {}, 0
    for i, t in enumerate(texts):
        found = exact(t)
        if found is None:
            odd[i] = t
            found = (last if chained else 0, 0)
        last = found[0]
        units.append(found[0])
        scales.append(found[1])
    coded = steps(units) if chained else to_varints(zigzag(np.array(units, np.int64)))
    return bytes(scales), coded, odd


def encode_batch(rows: list[Record]) -> bytes:
    """A whole batch. Index columns come from the frames that can be decoded; a frame is never put together from them."""
    if not rows or len(rows) > MOST_ROWS:
        raise ValueError(f"a batch of {len(rows)} rows")
    index = [decode(r.raw) if r.kind == "message" else {} for r in rows]
    index = [x if x and not x["decode_error"] else {} for x in index]
    kinds = {"message": MESSAGE, "gap": GAP, "reseed": RESEED}
    put: dict[str, bytes] = {"kind": bytes(kinds[r.kind] for r in rows), "recv": steps([r.recv_ns for r in rows])}
    for name, key in (("exchange", "exch_ns"), ("sequence", "seq")):
        present = [x.get(key) is not None for x in index]
        put[f"{name}.mask"], put[name] = mask(present), steps([x[key] for x, p in zip(index, present, strict=True) if p])
    sides = [x.get("side", "") for x in index]
    put["side.mask"], put["side.sell"] = mask([s != "" for s in sides]), mask([s == "sell" for s in sides])
    put["side.text"] = packed_sparse({i: packed_runs([s.encode()]) for i, s in enumerate(sides) if s not in ("", "buy", "sell")})
    for name in ("price", "size"):
        texts = [x.get(f"{name}_text", "") for x in index]
        place = [i for i, t in enumerate(texts) if t]
        scale, units, odd = decimals([texts[i] for i in place], chained=name == "price")
        put |= {f"{name}.mask": mask([t != "" for t in texts]), f"{name}.scale": scale, name: units, f"{name}.text": packed_sparse({place[i]: packed_runs([t.encode()]) for i, t in odd.items()})}
    types = [x.get("type", "") for x in index]
    words = list(dict.fromkeys(types))
    put["type"] = varint(len(words)) + packed_runs([w.encode() for w in words]) + to_varints(np.array([words.index(t) for t in types], np.uint64))
    put["gap"] = to_varints(np.array([v for r in rows if r.kind == "gap" for v in (r.expected, r.got)], np.uint64))
    put["reseed"] = packed_runs([r.reason.encode() for r in rows if r.kind == "reseed"])
    put["frames"] = packed_runs([r.raw for r in rows if r.kind == "message"])
    put["dropped"] = packed_sparse({i: varint(r.dropped) for i, r in enumerate(rows) if r.kind == "gap" and r.dropped})
    body = b"".join(block(NUMBER[name], put[name]) for name in COLUMNS)
    if len(body) > MOST_BODY:
        raise ValueError(f"a body of {len(body)} bytes")
    flags = HAS_GAP * any(r.kind == "gap" for r in rows) | HAS_RESEED * any(r.kind == "reseed" for r in rows)
    times = [r.recv_ns for r in rows]
    return struct.pack("<I", len(body)) + body + Footer(flags, len(rows), min(times), max(times), len(body), crc32c(body)).packed()


@dataclass
class Batch:
    """A decoded batch: its records, and the index columns by row (None where absent)."""

    records: list[Record]
    index: dict[str, list]


def spread(present: np.ndarray, values: list, what: str) -> list:
    if int(present.sum()) != len(values):
        raise Corrupt(f"the {what} column has {len(values)} values for {int(present.sum())} rows")
    out: list = [None] * len(present)
    for i, v in zip(np.flatnonzero(present).tolist(), values, strict=True):
        out[i] = v
    return out


def decimal_text(units: int, scale: int) -> str:
    digits = str(abs(units)).rjust(scale + 1, "0")
    return ("-" if units < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def decode_batch(body: bytes, footer: Footer) -> Batch:
    """A body against its footer. Columns of unknown numbers are left alone; every known one must be used up exactly."""
    got = {number: inflated(codec, raw, stored) for number, codec, raw, stored in walk_blocks(body)}
    of = lambda name: got.get(NUMBER[name], b"")
    n, kinds = footer.rows, np.frombuffer(of("kind"), np.uint8)
    if len(kinds) != n or not np.isin(kinds, (MESSAGE, GAP, RESEED)).all():
        raise Corrupt(f"{len(kinds)} kinds for {n} rows")
    recv = spread(np.ones(n, bool), summed(of("recv")).tolist(), "recv")
    index: dict[str, list] = {"exch_ns": spread(unmask(of("exchange.mask"), n), summed(of("exchange")).tolist(), "exchange")}
    index["seq"] = spread(unmask(of("sequence.mask"), n), summed(of("sequence")).view(np.uint64).tolist(), "sequence")
    text = lambda walk: walk.run().decode(errors="replace")
    odd = Walk(of("side.text")).sparse(text)
    sell, there = unmask(of("side.sell"), n), unmask(of("side.mask"), n)
    index["side"] = [None if not p else odd.get(i, "sell" if s else "buy") for i, (p, s) in enumerate(zip(there.tolist(), sell.tolist(), strict=True))]
    for name in ("price", "size"):
        units = summed(of(name)) if name == "price" else unzigzag(from_varints(of(name)))
        scales = list(of(f"{name}.scale"))
        if len(units) != len(scales):
            raise Corrupt(f"the {name} column has {len(units)} values and {len(scales)} scales")
        texts = spread(unmask(of(f"{name}.mask"), n), [decimal_text(u, s) for u, s in zip(units.tolist(), scales, strict=True)], name)
        for i, t in Walk(of(f"{name}.text")).sparse(text).items():
            if i < n and texts[i] is not None:
                texts[i] = t
        index[f"{name}_text"] = texts
    walk = Walk(of("type"))
    count = walk.number() if walk.data else 0
    if count > n:
        raise Corrupt(f"{count} types for {n} rows")
    words = [walk.run().decode(errors="replace") for _ in range(count)]
    places = from_varints(walk.data[walk.at :]).tolist()
    if walk.data and (len(places) != n or max(places, default=0) >= max(count, 1)):
        raise Corrupt("the type column points outside of its words")
    index["type"] = [words[p] for p in places] if walk.data else [""] * n
    gaps = from_varints(of("gap")).reshape(-1, 2) if not len(from_varints(of("gap"))) % 2 else None
    if gaps is None:
        raise Corrupt("the gap column has half a gap")
    dropped = Walk(of("dropped")).sparse(Walk.number)
    frames, reasons = Walk(of("frames")).runs(), Walk(of("reseed")).runs()
    if (len(frames), len(gaps), len(reasons)) != tuple(int((kinds == k).sum()) for k in (MESSAGE, GAP, RESEED)):
        raise Corrupt("frames, gaps or reseeds are not as many as the rows of their kind")
    each = iter(frames), iter(gaps.tolist()), iter(reasons)
    records = []
    for i, (kind, at) in enumerate(zip(kinds.tolist(), recv, strict=True)):
        if kind == MESSAGE:
            records.append(Record("message", at, raw=next(each[0])))
        elif kind == GAP:
            expected, to = next(each[1])
            records.append(Record("gap", at, expected=expected, got=to, dropped=dropped.get(i, 0)))
        else:
            records.append(Record("reseed", at, reason=next(each[2]).decode(errors="replace")))
    return Batch(records, index)


def read_bodies(f: BufferedIOBase, skip: bool = False) -> Iterator[tuple[bytes | None, Footer]]:
    """(body, footer) of each batch after the header, both checked; ``skip``: bodies are passed over and None."""
    while head := f.read(4):
        if len(head) < 4:
            raise Corrupt("a batch's length is cut off")
        (n,) = struct.unpack("<I", head)
        if n > MOST_BODY:
            raise Corrupt(f"a body of {n} bytes")
        if skip:
            f.seek(n, 1)
            body = None
        elif len(body := f.read(n)) < n:
            raise Corrupt("a body is cut off")
        footer = Footer.unpack(f.read(FOOTER.size))
        if footer.body != n or body is not None and crc32c(body) != footer.crc:
            raise Corrupt("a body fails its length or checksum")
        yield body, footer


def batches(rows: Iterator[Record], *, age_ns: int = AGE_NS, most_rows: int = ROWS, most_bytes: int = BYTES) -> Iterator[list[Record]]:
    """Records in runs that a batch holds."""
    held: list[Record] = []
    size = 0
    for r in rows:
        if held and (r.recv_ns - held[0].recv_ns >= age_ns or len(held) >= most_rows or size >= most_bytes):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r.raw)
    if held:
        yield held


def profile(f: BufferedIOBase) -> dict:
    """What a file is made of: ``batches, rows, gap_batches, bytes, framing, frame_bytes`` and ``columns`` (name to raw, stored bytes)."""
    out: dict = {"batches": 0, "rows": 0, "gap_batches": 0, "bytes": 8, "framing": 8, "frame_bytes": 0, "columns": {}}
    for body, footer in read_bodies(f):
        stored_bytes = 0
        for number, codec, raw, stored in walk_blocks(body or b""):
            name = COLUMNS[number - 1] if 0 < number <= len(COLUMNS) else f"unknown({number})"
            a, b = out["columns"].get(name, (0, 0))
            out["columns"][name] = (a + raw, b + len(stored))
            stored_bytes += len(stored)
            if name == "frames":
                out["frame_bytes"] += sum(map(len, Walk(inflated(codec, raw, stored)).runs()))
        size = 4 + footer.body + FOOTER.size
        out |= {"batches": out["batches"] + 1, "rows": out["rows"] + footer.rows, "gap_batches": out["gap_batches"] + footer.has_gap, "bytes": out["bytes"] + size, "framing": out["framing"] + size - stored_bytes}
    return out
