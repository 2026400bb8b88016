"""Canonical lines of a replay and their digest."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions.frames import decode, parsed

#: JSON strings, or white space between them.
SPACE = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+')
SECOND = 1_000_000_000


def quoted(text: str) -> str:
    """A JSON string: quotes, backslashes, control characters and the two line separators are escaped, nothing else."""
    return json.dumps(text, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def number_text(v: float) -> str:
    """The shortest decimal digits that give ``v`` again; an exponent only below 1e-6 and from 1e21 on."""
    if v == 0:
        return "-0" if math.copysign(1, v) < 0 else "0"
    digits, _, exponent = f"{repr(abs(v)).lower()}".partition("e")
    whole, _, part = digits.partition(".")
    part, power = part.rstrip("0"), int(exponent or 0)
    sign = "-" if v < 0 else ""
    if 1e-6 <= abs(v) < 1e21:
        figures, point = whole + part, len(whole) + power
        figures = figures.ljust(point, "0") if point > 0 else "0" * (1 - point) + figures
        point = max(point, 1)
        rest = figures[point:].rstrip("0")
        return sign + (figures[:point].lstrip("0") or "0") + ("." + rest if rest else "")
    figures = (whole + part).lstrip("0")
    power += len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0"))) - 1
    head, tail = figures[:1], figures[1:].rstrip("0")
    return f"{sign}{head}{'.' + tail if tail else ''}e{'+' if power > 0 else '-'}{abs(power):d}"


def time_text(ns: int | None) -> str:
    """RFC 3339 in UTC with as many decimals as needed; empty where absent."""
    if ns is None:
        return ""
    second, rest = divmod(ns, SECOND)
    days, second = divmod(second, 86400)
    era, day = divmod(days + 719468, 146097)  # days of 400 years, counted from a first of March
    year = (day - day // 1460 + day // 36524 - day // 146096) // 365
    day -= 365 * year + year // 4 - year // 100
    month = (5 * day + 2) // 153
    day = day - (153 * month + 2) // 5 + 1
    month = month + 3 if month < 10 else month - 9
    fraction = f".{rest:09d}".rstrip("0") if rest else ""
    return f"{year + era * 400 + (month <= 2):04d}-{month:02d}-{day:02d}T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}{fraction}Z"


def line(kind: str, i: int, file: str, rec: int, recv_ns: int, raw: bytes | None = None, expected: int = 0, got: int = 0, dropped: int = 0, reason: str = "", opening: bool = False) -> str:
    """One record. A frame stands as it is but for white space between tokens, or in base 64 if it is no JSON."""
    head = f'{{"i":{i},"kind":"{kind}","file":{quoted(file)},"rec":{rec},"recv":"{time_text(recv_ns)}",'
    if kind == "gap":
        missing = (got - expected + (1 << 63)) % (1 << 64) - (1 << 63)  # as 64 bits hold it
        return f'{head}"expected":{expected},"got":{got},"missing":{missing}{f",{chr(34)}dropped{chr(34)}:{dropped}" if dropped else ""}}}'
    if kind == "reseed":
        return f'{head}"reason":{quoted(reason)},"opening":{"true" if opening else "false"}}}'
    raw = raw or b""
    e = decode(raw)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = None
    frame = f'"raw":{SPACE.sub(r"\1", text)}' if text is not None and parsed(raw)[0] else f'"raw_b64":"{base64.b64encode(raw).decode()}"'
    error = f'"decode_error":{quoted(e["decode_error"])},' if e["decode_error"] else ""
    return (
        f'{head}"exchange_time":"{time_text(e["exch_ns"])}","channel":{quoted(e["channel"])},"type":{quoted(e["type"])},"product":{quoted(e["product"])},'
        f'"sequence":{"null" if e["seq"] is None else e["seq"]},"side":{quoted(e["side"])},"price":{number_text(e["price"])},"size":{number_text(e["size"])},{error}{frame}}}'
    )


def lines(replay: DataFrame) -> DataFrame:
    """``i, line``: one JSON line for each record of a replay.

    ``replay`` has ``i, kind, file_idx, rec, raw`` (text or binary), ``recv_ns`` or ``recv_us``, ``opening``, and where there are
    gaps and reseeds ``expected, got, dropped, reason``; ``file`` names the file, or else its index does. A frame that is no
    UTF-8 stands in base 64. Arrow batches, no order needed.
    """
    has = set(replay.columns)
    recv = F.col("recv_ns") if "recv_ns" in has else F.col("recv_us") * 1000
    wide = lambda c: F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)") if c in has else F.lit(0).cast("decimal(20,0)")
    source = replay.select(
        "i", "kind", (F.col("file") if "file" in has else F.col("file_idx").cast("string")).alias("file"), "rec", recv.cast("long").alias("recv"), F.col("raw").cast("binary").alias("raw"),
        *[wide(c).alias(c) for c in ("expected", "got", "dropped")], F.coalesce(F.col("reason") if "reason" in has else F.lit(""), F.lit("")).alias("reason"), F.coalesce("opening", F.lit(False)).alias("opening"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            made = [line(kind, i, file, rec, at, raw, int(x), int(got), int(n), why, opening) for i, kind, file, rec, at, raw, x, got, n, why, opening in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["i", "line"])

    return source.mapInArrow(run, "i long, line string")


def digest(canonical: DataFrame) -> str:
    """SHA-256 of the lines in order, each with a line feed, streamed through the driver a partition at a time."""
    h = hashlib.sha256()
    for row in canonical.orderBy("i").select("line").toLocalIterator():
        h.update(row[0].encode() + b"\n")
    return h.hexdigest()
