"""What a person reads: counts, sizes, durations, meters, padded cells and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The glyphs of the eight levels, a meter's full and empty cell, units of bytes, column widths of a row.
RAMP = {True: "▁▂▃▄▅▆▇█", False: "_.-~=+*#"}
METER = {True: ("█", "░"), False: ("#", "-")}
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")
WIDTHS = {"time": 12, "channel": 12, "type": 13, "sequence": 13, "side": 4, "price": 11, "size": 12}
US, MS, S = 1_000, 1_000_000, 1_000_000_000


def count_text(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def rounded(v: Column, digits: int) -> Column:
    """Fixed decimals; halves go to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(v.cast("double"), digits))


def bytes_text(n: Column) -> Column:
    """Binary units up to TiB, three figures."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[1:], 1):
        v = n / F.lit(float(1024**i))
        figures = F.when(v < 10, rounded(v, 2)).when(v < 100, rounded(v, 1)).otherwise(rounded(v, 0))
        out = F.when(n >= 1024**i, F.concat(figures, F.lit(f" {unit}"))).otherwise(out)
    return out


def elapsed_text(ns: Column) -> Column:
    """h:mm:ss; nothing is below 0."""
    s = F.floor(F.greatest(ns, F.lit(0)) / S)
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def round_to(ns: Column, step: int) -> Column:
    """To the nearest multiple; halves go away from zero."""
    return F.signum(ns).cast("long") * F.floor((F.abs(ns) + step // 2) / step).cast("long") * step


def latency_rounded(ns: Column) -> Column:
    """A duration to about three figures of its unit."""
    return F.when(ns >= S, round_to(ns, MS)).when(ns >= MS, round_to(ns, US)).when(ns >= US, round_to(ns, 10)).otherwise(ns)


def plain(v: Column, digits: int) -> Column:
    """A number with up to ``digits`` decimals and no zeros at its end."""
    return F.regexp_replace(rounded(v, digits), r"\.?0+$", "")


def short_text(ns: Column) -> Column:
    """A small duration, rounded, in its largest unit up to seconds (below a minute)."""
    r = latency_rounded(ns)
    return F.when(r >= S, F.concat(plain(r / S, 3), F.lit("s"))).when(r >= MS, F.concat(plain(r / MS, 3), F.lit("ms"))).when(r >= US, F.concat(plain(r / US, 2), F.lit("µs"))).when(r == 0, "0s").otherwise(F.concat(r.cast("string"), F.lit("ns")))


def rate_text(v: Column) -> Column:
    return F.when(v <= 0, "0/s").when(v < 10, F.concat(rounded(v, 1), F.lit("/s"))).otherwise(F.concat(rounded(v, 0), F.lit("/s")))


def quantity_text(v: Column) -> Column:
    """A number in thousands or millions."""
    return F.when(v >= 1e6, F.concat(rounded(v / 1e6, 2), F.lit("M"))).when(v >= 1e3, F.concat(rounded(v / 1e3, 1), F.lit("k"))).otherwise(rounded(v, 0))


def percent_text(f: Column) -> Column:
    return F.when(f == 0, "0").otherwise(F.concat(rounded(f * 100, 1), F.lit("%")))


def truncated(text: Column, width: int) -> Column:
    """At most ``width`` characters; a cut is marked where there is room."""
    if width <= 0:
        return F.lit("")
    cut = F.substring(text, 1, 1) if width == 1 else F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def padded(text: Column, width: int) -> Column:
    """Exactly ``width`` characters, from the left."""
    return F.rpad(truncated(text, width), width, " ") if width > 0 else F.lit("")


def padded_left(text: Column, width: int) -> Column:
    return F.lpad(truncated(text, width), width, " ") if width > 0 else F.lit("")


def meter(v: Column, most: Column, width: int, unicode: bool = False) -> Column:
    """``v`` of ``most`` as ``width`` cells; what is not nothing has a cell at least."""
    full, empty = METER[unicode]
    n = F.when((most <= 0) | (v <= 0), 0).when(v >= most, width).otherwise(F.greatest(F.floor(v / most * width), F.lit(1))).cast("int")
    return F.concat(F.repeat(F.lit(full), n), F.repeat(F.lit(empty), F.lit(width) - n)) if width > 0 else F.lit("")


def glyph(level: Column, unicode: bool = False) -> Column:
    """The character of a level, 0 to 7."""
    return F.substring(F.lit(RAMP[unicode]), F.greatest(F.least(level, F.lit(7)), F.lit(0)).cast("int") + 1, F.lit(1))


def clock(exch_us: Column, recv_us: Column) -> Column:
    """The exchange's time of day, else the local one, to the millisecond; empty if there is neither."""
    return F.coalesce(F.date_format(F.timestamp_micros(F.coalesce(exch_us, recv_us)), "HH:mm:ss.SSS"), F.lit(""))


def file_label(path: Column) -> Column:
    """The last two folders and the name; shorter paths as they are."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(path == "", "(none open)").when(F.size(parts) >= 3, F.array_join(F.slice(parts, -3, 3), "/")).otherwise(path)


def banner(text: Column, width: int, rule: str = "=") -> Column:
    """``text`` in the middle of a line of ``width``."""
    n = F.length(text)
    left = F.floor((F.lit(width) - n) / 2).cast("int")
    return F.when(n >= width, truncated(F.trim(text), width)).otherwise(F.concat(F.repeat(F.lit(rule), left), text, F.repeat(F.lit(rule), F.lit(width) - left - n)))


def layout(width: int) -> list[str]:
    """The columns that a row of ``width`` has room for: the channel goes first, then the sequence, then the type."""
    shown = list(WIDTHS)
    for name in ("channel", "sequence", "type"):
        if sum(WIDTHS[c] + 1 for c in shown) - 1 > width:
            shown.remove(name)
    return shown


def pretty(width: int) -> Column:
    """A replayed record as a row, or as a banner of ``width`` where the feed broke. The banners' words are fixed values."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = {"time": padded(clock(F.col("exch_us"), F.col("recv_us")), 12), "channel": padded(text("channel"), 12), "type": padded(text("etype"), 13), "sequence": padded(text("seq"), 13), "side": padded(text("side"), 4), "price": padded_left(text("price_text"), 11), "size": padded_left(text("size_text"), 12)}
    row = F.rtrim(F.concat_ws(" ", *[cells[c] for c in layout(width)]))
    at = clock(F.lit(None).cast("long"), F.col("recv_us"))
    say = lambda *parts: banner(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), width)
    shed = say(" GAP  capture dropped ", count_text(F.col("dropped")), " frames  at ", at, " ")
    missed = say(" GAP  ", count_text(F.col("got") - F.col("expected")), " messages missing  expected ", count_text(F.col("expected")), ", got ", count_text(F.col("got")), "  at ", at, " ")
    opens, again = say(" window opens  ", F.col("reason"), "  at ", at, " "), say(" RESEED  the book was rebuilt here  ", F.col("reason"), "  at ", at, " ")
    return F.when(F.col("kind") == "message", row).when(F.col("kind") == "gap", F.when(F.col("dropped") > 0, shed).otherwise(missed)).otherwise(F.when(F.col("opening"), opens).otherwise(again))


def discontinuity_text(time: Column) -> Column:
    """What broke, where and when, of ``kind, file_idx, rec, dropped, expected, got, reason``. The sentences are fixed values."""
    where = F.concat(F.lit(" at file "), F.col("file_idx").cast("string"), F.lit(" record "), F.col("rec").cast("string"), F.lit(": "))
    n = lambda c: c.cast("string")
    shed = F.concat(F.lit("gap"), where, F.lit("capture dropped "), n(F.col("dropped")), F.lit(" frames at "), time)
    missed = F.concat(F.lit("gap"), where, F.lit("expected sequence "), n(F.col("expected")), F.lit(", got "), n(F.col("got")), F.lit(" ("), n(F.col("got") - F.col("expected")), F.lit(" missing) at "), time)
    return F.when((F.col("kind") == "gap") & (F.col("dropped") > 0), shed).when(F.col("kind") == "gap", missed).otherwise(F.concat(F.lit("reseed"), where, F.col("reason"), F.lit(" at "), time))
