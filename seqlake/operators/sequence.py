"""Sequence tracking: gaps, regressions, reconnect gaps and stale messages as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.arrival import running_count


def classified(records: DataFrame, mode: str) -> DataFrame:
    """Sequenced messages with ``anomaly`` (none, gap, regression, reconnect_gap, stale), ``expected`` and ``missing``.

    ``contiguous``: each number must follow the last; ``monotonic``: numbers must only grow. After a reseed a
    product's next number may fall back (stale) or jump (reconnect gap). Frames that could not be decoded (``bad`` is not 0,
    if there is such a column) are not looked at. Files are worked on side by side: one row for each file and product carries
    the highest number and the last epoch over.
    """
    if mode not in ("contiguous", "monotonic"):
        raise ValueError(mode)
    rows = running_count(records, "epoch", F.col("kind") == "reseed").where("kind = 'message' and seq is not null")
    if "bad" in records.columns:
        rows = rows.where("bad = 0")
    ends = rows.groupBy("file_idx", "product").agg(F.max("seq").alias("top"), F.max_by("epoch", "rec").alias("seen"))
    earlier = Window.partitionBy("product").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file_idx", "product", F.struct(F.max("top").over(earlier).alias("top"), F.last("seen").over(earlier).alias("seen")).alias("from"))
    ends = ends.groupBy("file_idx").agg(F.map_from_entries(F.collect_list(F.struct("product", "from"))).alias("__from"))  # a file has few products
    here = Window.partitionBy("file_idx", "product").orderBy("rec")
    rows = rows.withColumns({"__hwm": F.max("seq").over(here.rowsBetween(Window.unboundedPreceding, -1)), "__seen": F.lag("epoch").over(here)})
    before = F.col("__from")[F.col("product")]
    rows = rows.join(ends, "file_idx").withColumns({"hwm": F.greatest("__hwm", before["top"]), "reseeded": F.col("epoch") != F.coalesce("__seen", before["seen"])}).drop("__from", "__hwm", "__seen")
    hwm, seq, reseeded = F.col("hwm"), F.col("seq"), F.col("reseeded")
    anomaly = (
        F.when(hwm.isNull(), "none").when(reseeded & (seq <= hwm), "stale").when(reseeded & (seq != hwm + 1), "reconnect_gap")
        .when(reseeded, "none").when(seq <= hwm, "regression").when(F.lit(mode == "contiguous") & (seq != hwm + 1), "gap").otherwise("none")
    )
    return rows.withColumns({"anomaly": anomaly, "expected": hwm + 1, "missing": seq - hwm - 1}).drop("hwm", "reseeded", "epoch")


def with_gap_rows(records: DataFrame, mode: str) -> DataFrame:
    """The records with a gap row before each message that reveals one (``sub`` 0; the records have 1), stamped with its time."""
    found = classified(records, mode).where("anomaly in ('gap', 'regression', 'reconnect_gap')")
    gaps = found.select("arrival", "file_idx", "rec", F.lit(0).alias("sub"), F.lit("gap").alias("kind"), "product", "recv_us", "expected", F.col("seq").alias("got"), "missing", "anomaly")
    none = F.lit(None)
    own = records.select("arrival", "file_idx", "rec", F.lit(1).alias("sub"), "kind", "product", "recv_us", none.cast("long").alias("expected"), none.cast("long").alias("got"), none.cast("long").alias("missing"), none.cast("string").alias("anomaly"))
    return gaps.unionByName(own)


def drop_runs(records: DataFrame, dropped: F.Column) -> DataFrame:
    """One gap row for each run of dropped records, before the next kept one; a trailing run has no next (``next_arrival`` null)."""
    rows = records.withColumn("__drop", dropped)
    rows = running_count(rows, "grp", ~F.col("__drop"), upto_here=False)
    return rows.groupBy("grp").agg(F.sum(F.when(F.col("__drop"), 1).otherwise(0)).cast("long").alias("dropped"), F.min(F.when(~F.col("__drop"), F.col("arrival"))).alias("next_arrival"), F.min(F.when(F.col("__drop"), F.col("recv_us"))).alias("first_us")).where("dropped > 0")
