"""Window summaries: replay statistics, interval metrics and alarms, latency histograms, timelines, load figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def replay_stats(records: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return records.agg(F.count("*").alias("records"), count_if(kind == "message").alias("messages"), count_if(kind == "gap").alias("gaps"), count_if(kind == "reseed").alias("reseeds"), F.sum(F.octet_length(F.coalesce("props", F.lit(""))) + 13).cast("long").alias("bytes"), F.min("recv_us").alias("first_us"), F.max("recv_us").alias("last_us"), (F.max("recv_us") - F.min("recv_us")).alias("span_us"))


#: Bucket of the latency ``lat``: exact below 8, then eight to each power of two.
HIST_INDEX = "case when lat < 8 then lat else (length(bin(lat)) - 3) * 8 + (shiftright(lat, length(bin(lat)) - 4) & 7) end"


def hist_upper(b: Column) -> Column:
    """The largest latency of a bucket."""
    return F.when(b < 8, b).otherwise(F.expr("shiftleft(9 + bucket % 8, cast(floor(bucket / 8) as int) - 1) - 1")).cast("long")


def latency_histogram(latencies: DataFrame) -> DataFrame:
    """``bucket, n`` of the column ``lat``."""
    return latencies.withColumn("bucket", F.expr(HIST_INDEX).cast("long")).groupBy("bucket").agg(F.count("*").alias("n"))


def latency_quantiles(latencies: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """``q, value``: nearest-rank quantiles as bucket ends, at most the largest latency."""
    hist = latency_histogram(latencies)
    top, total = latencies.agg(F.max("lat"), F.count("*")).first()
    running = hist.withColumn("cum", F.sum("n").over(Window.orderBy("bucket")))
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(-(-int(q * 1000) * total // 1000)).cast("long").alias("rank")) for q in quantiles])).alias("a")
    return running.select("bucket", "cum", asked).where(F.col("cum") >= F.greatest(F.col("a.rank"), F.lit(1))).groupBy(F.col("a.q").alias("q")).agg(F.min("bucket").alias("bucket")).select("q", F.least(hist_upper(F.col("bucket")), F.lit(top)).alias("value"))


def interval_metrics(records: DataFrame, interval_us: int) -> DataFrame:
    """Per interval, empty ones included: messages, rate, gaps, reseeds, and the lag's count, sum, least and most (null if not measured)."""
    slot = F.floor(F.col("recv_us") / interval_us).cast("long")
    lag = F.when(F.col("kind") == "message", F.abs(F.col("recv_us") - F.col("exch_us")))
    found = records.groupBy(slot.alias("slot")).agg(count_if(F.col("kind") == "message").alias("messages"), count_if(F.col("kind") == "gap").alias("gaps"), count_if(F.col("kind") == "reseed").alias("reseeds"), F.count(lag).alias("lag_n"), F.sum(lag).alias("lag_sum"), F.min(lag).alias("lag_min"), F.max(lag).alias("lag_max"))
    spine = records.agg(F.min(slot).alias("a"), F.max(slot).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("slot"))
    filled = spine.join(found, "slot", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("messages", "gaps", "reseeds", "lag_n")}
    return filled.withColumns(zero).withColumn("rate", F.col("messages") / F.lit(interval_us / US))


def metric_datums(metrics: DataFrame) -> DataFrame:
    """One row for each named figure of an interval; a lag that was not measured has none, a true zero has one."""
    rows = F.expr("stack(5, 'Messages', cast(messages as double), 'MessageRate', rate, 'SequenceGaps', cast(gaps as double), 'Reseeds', cast(reseeds as double), 'LagMaximum', cast(lag_max as double)) as (name, value)")
    return metrics.select("slot", rows).where("value is not null")


def alarm(metrics: DataFrame, breach: Column, periods: int) -> DataFrame:
    """``slot, alarm``: the condition held in each of the last ``periods`` intervals; what is missing doesn't breach."""
    w = Window.orderBy("slot").rowsBetween(1 - periods, 0)
    one = F.when(F.coalesce(breach, F.lit(False)), 1).otherwise(0)
    return metrics.select("slot", ((F.min(one).over(w) == 1) & (F.count(one).over(w) == periods)).alias("alarm"))


def timeline(replay: DataFrame, most: int = 4096, step_us: int = 1000) -> DataFrame:
    """``bucket, n``: message density in buckets of ``step_us`` times the least power of two that needs fewer than ``most``."""
    messages = replay.where("kind = 'message'")
    origin = messages.agg(F.min_by("recv_us", "i")).first()[0]
    if origin is None:
        return messages.selectExpr("cast(0 as bigint) as bucket", "cast(0 as bigint) as n")
    off = F.greatest(F.col("recv_us") - F.lit(origin), F.lit(0))
    widest = messages.agg(F.max(off)).first()[0]
    k = 0
    while widest // (step_us << k) >= most:
        k += 1
    return messages.groupBy(F.floor(off / F.lit(step_us << k)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def timeline_marks(replay: DataFrame, width: int) -> DataFrame:
    """``column, mark`` on ``width`` columns: the highest of file start (1), reseed (2) and gap (3)."""
    first, last = replay.agg(F.min("recv_us"), F.max("recv_us")).first()
    starts = replay.groupBy("file_idx").agg(F.min_by("recv_us", "i").alias("at")).select("at", F.lit(1).alias("rank"))
    marks = starts.union(replay.where("kind = 'reseed' and not opening").select("recv_us", F.lit(2))).union(replay.where("kind = 'gap'").select("recv_us", F.lit(3)))
    span = max((last or 0) - (first or 0), 0)
    at = F.least(F.greatest(F.floor((F.col("at") - F.lit(first or 0)) * width / F.lit(span or 1)), F.lit(0)), F.lit(width - 1)) if span else F.lit(0)
    return marks.groupBy(at.cast("long").alias("column")).agg(F.max("rank").cast("long").alias("mark"))


def load_stats(records: DataFrame) -> DataFrame:
    m = records.where("kind = 'message'")
    span = F.max_by("recv_us", "arrival") - F.min_by("recv_us", "arrival")
    return m.agg(F.count("*").alias("messages"), span.alias("span_us"), (F.max("seq") - F.min("seq") + 1).cast("long").alias("seq_span"), F.when(span > 0, F.count("*") * 1e6 / span).otherwise(0.0).alias("rate"))


def amplified(records: DataFrame, times: int) -> DataFrame:
    """The load pushed ``times`` over: each pass is later by the span and one, and its numbers are higher by their span."""
    m = records.where("kind = 'message'")
    span, seq_span = m.agg(F.max_by("recv_us", "arrival") - F.min_by("recv_us", "arrival"), F.max("seq") - F.min("seq") + 1).first()
    n = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("pass")
    rows = m.select("arrival", "product", "recv_us", "seq", n)
    return rows.select("pass", "arrival", "product", (F.col("recv_us") + F.col("pass") * F.lit((span or 0) + 1)).alias("recv_us"), (F.col("seq") + F.col("pass") * F.lit(seq_span or 0)).cast("long").alias("seq"))


def session_summary(records: DataFrame, window_us: int) -> DataFrame:
    """One row: everything a capture session counts over its records, and its rate (0 for no time)."""
    from seqlake.functions.scalars import window_start
    from seqlake.operators.sequence import classified

    kind, span = F.col("kind"), F.max("recv_us") - F.min("recv_us")
    one = records.agg(
        F.count("*").alias("records"), count_if(kind == "message").alias("messages"), F.sum(F.octet_length(F.coalesce("raw", F.lit("")))).cast("long").alias("bytes"),
        (F.count_distinct(window_start(F.col("recv_us"), window_us)) - 1).alias("rotations"), count_if(kind == "reseed").alias("reseeds"), count_if(kind == "gap").alias("gaps"),
        count_if(F.col("bad").isin(1, 2)).alias("decode_errors"), count_if(F.coalesce(F.col("etype") == "error", F.lit(False))).alias("exchange_errors"), F.coalesce(F.sum("dropped"), F.lit(0)).cast("long").alias("dropped"),
        F.when(span > 0, count_if(kind == "message") * 1e6 / span).otherwise(0.0).alias("rate"),
    )
    stale = classified(records, "contiguous").agg(count_if(F.col("anomaly") == "stale").alias("stale"))
    return one.join(F.broadcast(stale)).withColumn("stale", F.coalesce("stale", F.lit(0)))  # one row each


def product_metrics(records: DataFrame, anomalies: DataFrame, interval_us: int) -> DataFrame:
    """``slot, product`` and, as in ``interval_metrics``, the figures of each product's intervals; ``anomalies`` are classified messages."""
    slot = F.floor(F.col("recv_us") / interval_us).cast("long")
    lag = F.abs(F.col("recv_us") - F.col("exch_us"))
    m = records.where("product <> ''")
    found = m.groupBy(slot.alias("slot"), "product").agg(count_if(F.col("kind") == "message").alias("messages"), F.count(lag).alias("lag_n"), F.sum(lag).alias("lag_sum"), F.min(lag).alias("lag_min"), F.max(lag).alias("lag_max"))
    broken = anomalies.where("anomaly in ('gap', 'regression', 'reconnect_gap') and product <> ''").groupBy(slot.alias("slot"), "product").agg(F.count("*").alias("anomalies"))
    ends = records.agg(F.min(slot).alias("a"), F.max(slot).alias("b"))
    spine = m.select("product").distinct().join(F.broadcast(ends)).select("product", F.explode(F.sequence("a", "b")).alias("slot"))  # one row of ends
    filled = spine.join(found, ["slot", "product"], "left").join(broken, ["slot", "product"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("messages", "anomalies", "lag_n")}
    return filled.withColumns(zero).withColumn("rate", F.col("messages") / F.lit(interval_us / US))


def product_datums(metrics: DataFrame) -> DataFrame:
    """``slot, product, name, unit`` with a ``value``, or with the statistics ``n, total, least, most``; what was not measured is left out."""
    none = "cast(null as bigint), cast(null as double), cast(null as double), cast(null as double)"
    rows = F.expr(
        f"stack(4, 'Messages', 'Count', cast(messages as double), {none}, 'MessageRate', 'Count/Second', rate, {none}, 'SequenceGaps', 'Count', cast(anomalies as double), {none},"
        " 'IngestLag', 'Seconds', cast(null as double), lag_n, lag_sum / 1e6, lag_min / 1e6, lag_max / 1e6) as (name, unit, value, n, total, least, most)"
    )
    return metrics.select("slot", "product", rows).where("value is not null or n > 0")


def timeline_columns(replay: DataFrame, width: int) -> DataFrame:
    """``column, n``: message density on ``width`` columns between the first and the last record."""
    first, last = replay.agg(F.min("recv_us"), F.max("recv_us")).first()
    messages = replay.where("kind = 'message'")
    origin = messages.agg(F.min_by("recv_us", "i")).first()[0]
    off = F.greatest(F.col("recv_us") - F.lit(origin), F.lit(0))
    step = 1000
    widest = (messages.agg(F.max(off)).first()[0] or 0) if origin is not None else 0
    while widest // step >= 4096:
        step *= 2
    at = F.lit(origin or 0) + F.floor(off / F.lit(step)) * step
    span = max((last or 0) - (first or 0), 0)
    column = F.least(F.greatest(F.floor((at - F.lit(first or 0)) * width / F.lit(span)), F.lit(0)), F.lit(width - 1)) if span else F.lit(0)
    return messages.groupBy(column.cast("long").alias("column")).agg(F.count("*").alias("n"))
