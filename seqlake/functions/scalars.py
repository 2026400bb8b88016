"""Scalar functions of the feed: channels, exact decimals, storage keys, ramps, nanosecond times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which channel carries a message type.
CHANNELS = {"match": "matches", "last_match": "matches", "snapshot": "level2_batch", "l2update": "level2_batch"}
CONTROL = ("subscriptions", "error", "heartbeat", "")
EXACT = r"^-?(0|[1-9][0-9]*)(\.[0-9]{1,18})?$"


def channel_of(kind: Column) -> Column:
    out = F.lit("control")
    for k, v in CHANNELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.coalesce(out, F.lit("control"))


def is_control(kind: Column) -> Column:
    """Frames of the protocol itself, those without a type among them."""
    return F.coalesce(kind.isin(*CONTROL), F.lit(True))


def is_error(kind: Column) -> Column:
    return F.coalesce(kind == "error", F.lit(False))


def decimal_units(text: Column) -> Column:
    """Digits of an exact decimal as a whole number; null where its text could not be given back as it is."""
    units = F.regexp_replace(text, r"\.", "").try_cast("long")
    return F.when(text.rlike(EXACT) & ~text.rlike(r"^-[0.]*$"), units)


def decimal_scale(text: Column) -> Column:
    return F.when(text.contains("."), F.length(text) - F.instr(text, ".")).otherwise(0).cast("int")


def decimal_text(units: Column, scale: Column) -> Column:
    """The exact text of ``units`` with ``scale`` decimals, padded with zeros."""
    digits = F.abs(units).cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), scale + 1), F.lit("0"))
    whole = padded.substr(F.lit(1), F.length(padded) - scale)
    rest = padded.substr(F.length(padded) - scale + 1, scale)
    return F.concat(F.when(units < 0, "-").otherwise(""), whole, F.when(scale > 0, F.concat(F.lit("."), rest)).otherwise(""))


def storage_key(symbol: Column, start_us: Column) -> Column:
    """The partitioned path of the file that starts at ``start_us`` (UTC)."""
    at = F.timestamp_micros(start_us)
    return F.concat(F.lit("v1/symbol="), symbol, F.date_format(at, "'/date='yyyy-MM-dd'/hour='HH'/'"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z.tape'"))


def window_start(at_us: Column, window_us: int) -> Column:
    """Start of the tumbling window, counted from the year 1, not from 1970."""
    origin = 62_135_596_800_000_000
    return (at_us - F.pmod(at_us + F.lit(origin), F.lit(window_us))).cast("long")


def ramp(v: Column, most: Column) -> Column:
    """0 only for nothing, 1 to 7 for a share of ``most``."""
    return F.when((v <= 0) | (most <= 0), 0).when(v >= most, 7).otherwise(F.least(F.lit(7), F.floor(v * 7 / most) + 1)).cast("long")


def nanoseconds(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time, in UTC or at an offset; null where it is none."""
    good = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$")
    seconds = F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0").cast("long")
    part = lambda i: F.regexp_extract(text, r"([+-])(\d\d):(\d\d)$", i)
    offset = F.when(text.endswith("Z"), 0).otherwise((part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60) * F.when(part(1) == "-", -1).otherwise(1))
    return F.when(good, (seconds - offset) * 1_000_000_000 + F.coalesce(fraction, F.lit(0)))


#: The member of a frame that numbers it, and its digits.
SEQUENCE = r'"sequence":([0-9]+)'


def sequence_at(raw: Column) -> Column:
    """How many bytes stand before the first sequence number's digits; null where there is none."""
    before = F.regexp_extract(raw, r'(?s)^(.*?"sequence":)[0-9]', 1)
    return F.when(before != "", F.octet_length(before).cast("long"))


def with_sequence_advanced(raw: Column, by: Column) -> Column:
    """The frame with its first sequence number ``by`` higher; a frame without one stays as it is."""
    before, digits = F.regexp_extract(raw, r'(?s)^(.*?"sequence":)[0-9]', 1), F.regexp_extract(raw, SEQUENCE, 1)
    number = (digits.try_cast("decimal(20,0)") + by).cast("decimal(20,0)").cast("string")
    return F.when((before != "") & (by != 0), F.concat(before, number, raw.substr(F.length(before) + F.length(digits) + 1, F.length(raw)))).otherwise(raw)


def valid_symbol(symbol: Column) -> Column:
    """Whether a symbol can stand in a key: not empty, without ``/`` and ``=``."""
    return F.coalesce((symbol != "") & ~symbol.rlike("[/=]"), F.lit(False))


def time_text(ns: Column) -> Column:
    """RFC 3339 with as many decimals as it needs; empty where absent."""
    second = F.floor(ns / 1_000_000_000)
    fraction = F.rtrim(F.lpad((F.pmod(ns, F.lit(1_000_000_000))).cast("string"), 9, "0"), F.lit("0"))
    return F.when(ns.isNull(), "").otherwise(F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z")))
