"""Strict decoding of JSON frames; the raw frame stays the record."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame

from seqlake.functions.scalars import CHANNELS

TEXTS = ("type", "product_id", "time", "side", "price", "size", "message", "reason")
TIME = re.compile(r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)$")
FLOAT = re.compile(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$")
FIELDS = "type string, channel string, product string, side string, exch_ns long, seq decimal(20,0), price_text string, size_text string, price double, size double, decode_error string, error_text string"


def exchange_ns(text: str) -> int:
    found = TIME.match(text)
    if not found:
        raise ValueError(text)
    at = datetime.fromisoformat(found[1]).replace(tzinfo=timezone.utc)
    if found[3] != "Z":
        at -= (1 if found[3][0] == "+" else -1) * timedelta(hours=int(found[3][1:3]), minutes=int(found[3][4:]))
    whole = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (whole.days * 86400 + whole.seconds) * 10**9 + int((found[2] or "").ljust(9, "0"))


#: The texts of what can fail; the value at fault follows where there is one.
NO_OBJECT, NO_TIME, NO_NUMBER = "decode frame: no JSON object of the expected types", "parse time", "parse"


def parsed(raw: bytes) -> tuple[bool, object]:
    """(whether ``raw`` is JSON, its value). Bytes that are no UTF-8 are read as U+FFFD; too deep a nesting is no JSON."""

    def refuse(word: str):
        raise ValueError(word)

    try:
        return True, json.loads(raw.decode("utf-8", "replace"), parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, None


def number(text: str) -> float:
    """A decimal number; what is none, or larger than a double can hold, is refused."""
    value = float(text) if FLOAT.match(text) else math.inf
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def decode(raw: bytes) -> dict:
    """The fields of a frame. What fails ends decoding there, and what was read before it stays.

    A frame that is no JSON object of the right types has an empty type and an empty channel (not control).
    """
    out = {"type": "", "channel": "", "product": "", "side": "", "exch_ns": None, "seq": None, "price_text": "", "size_text": "", "price": 0.0, "size": 0.0, "decode_error": "", "error_text": ""}
    known, body = parsed(raw)
    if not known or not (body is None or isinstance(body, dict)):
        return out | {"decode_error": NO_OBJECT}
    fields = {k.lower(): v for k, v in (body or {}).items()}
    seq = fields.get("sequence")
    if any(fields.get(k) is not None and not isinstance(fields[k], str) for k in TEXTS) or not (seq is None or type(seq) is int and 0 <= seq < 1 << 64):
        return out | {"decode_error": NO_OBJECT}
    text = {k: fields.get(k) or "" for k in TEXTS}
    out |= {"type": text["type"], "channel": CHANNELS.get(text["type"], "control"), "product": text["product_id"], "side": text["side"], "seq": seq, "price_text": text["price"], "size_text": text["size"]}
    if text["type"] == "error":
        out["error_text"] = text["message"] + (": " + text["reason"] if text["reason"] else "")
    try:
        if text["time"]:
            out["exch_ns"] = exchange_ns(text["time"])
    except ValueError:
        return out | {"decode_error": f'{NO_TIME} "{text["time"]}"'}
    for k in ("price", "size"):
        try:
            out[k] = number(text[k]) if text[k] else 0.0
        except ValueError:
            return out | {"decode_error": f'{NO_NUMBER} {k} "{text[k]}"'}
    return out


def decoded(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """``frames`` with the fields decoded from ``raw`` (binary or string; null counts as empty); a row in for a row out."""
    from decimal import Decimal

    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [decode(x.encode() if isinstance(x, str) else bytes(x or b"")) for x in pdf[raw]]
            for n in names:
                column = [r[n] for r in rows]
                pdf[n] = pd.Series([None if v is None else Decimal(v) for v in column] if n == "seq" else column, index=pdf.index, dtype="Int64" if n == "exch_ns" else None)
            yield pdf

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInPandas(run, f"{own}, {FIELDS}")
