"""What a stored window is made of: totals, formats, columns, uploads, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def census(profiles: DataFrame) -> DataFrame:
    """``version, files``."""
    return profiles.groupBy("version").agg(F.count("*").alias("files"))


def totals(profiles: DataFrame) -> DataFrame:
    """One row for a window's files (the source's ``profile`` rows): sizes, records, batches, batches that carry the gap flag, ratios."""
    added = {"records": "rows", "batches": "batches", "gap_batches": "gap_batches", "stored": "stored", "columnar": "bytes", "frame_bytes": "frame_bytes", "framing": "framing"}
    one = profiles.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in added.items()])
    return one.withColumns({"ratio_frames": ratio(F.col("frame_bytes"), F.col("columnar")), "ratio_stored": ratio(F.col("stored"), F.col("columnar"))})


def storage_profile(profiles: DataFrame) -> DataFrame:
    """``name, raw, stored, share, ratio`` of each column over a window's files, the largest first, then by name."""
    whole = totals(profiles).select("columnar")
    columns = profiles.select(F.explode("columns").alias("c")).groupBy(F.col("c.name").alias("name")).agg(F.sum("c.raw").alias("raw"), F.sum("c.stored").alias("stored"))
    rows = columns.join(F.broadcast(whole))  # one row
    return rows.select("name", "raw", "stored", ratio(F.col("stored"), F.col("columnar")).alias("share"), ratio(F.col("raw"), F.col("stored")).alias("ratio")).orderBy(F.desc("stored"), "name")


def upload_stats(events: DataFrame) -> DataFrame:
    """Counts of upload events (``outcome, attempts, bytes``): added, each outcome, retries, bytes, and what is still pending.

    An outcome that is null has not come yet.
    """
    is_ = lambda k: F.coalesce(F.sum(F.when(F.col("outcome") == k, 1).otherwise(0)), F.lit(0)).cast("long").alias(k)
    names = ("uploaded", "existed", "failed", "dropped")
    one = events.agg(F.count("*").alias("added"), *map(is_, names), F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("long").alias("retries"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    return one.withColumn("pending", F.expr("added - (uploaded + existed + failed + dropped)"))


def publisher_stats(attempts: DataFrame) -> DataFrame:
    """Counts of publishing attempts (``slot, datapoints, ok``): intervals, published, failed, datapoints that arrived."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return attempts.agg(F.count("*").alias("intervals"), n(F.col("ok")).alias("published"), n(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("datapoints"))), F.lit(0)).cast("long").alias("datapoints"))
