"""Running values over a window's arrival order, file by file, and places in a total order.

An ordered window over one large symbol would be one task. Files are worked on side by side instead; each gives one row, and
running over these few rows gives what each file starts from. All windows here ask for the same dealing by ``file_idx``, so
records that are dealt that way are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.sources.staging import cut


def in_file():
    return Window.partitionBy("file_idx").orderBy("rec")


def files_before():
    """Over one row for each file."""
    return Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, counts: dict[str, tuple[Column, bool]], lasts: dict[str, Column]) -> DataFrame:
    """``df`` with running columns over arrival order, all by one window and one row for each file.

    ``counts``: name to (flag, whether this row counts): how many rows up to here have the flag. ``lasts``: name to a value:
    its last one that isn't null up to this row.
    """
    one = {k: F.when(flag, 1).otherwise(0) for k, (flag, _) in counts.items()}
    rows = df.withColumns({f"__v_{k}": v for k, v in lasts.items()})
    files = rows.groupBy("file_idx").agg(
        *[F.sum(v).alias(f"__n_{k}") for k, v in one.items()],
        *[F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), F.col("rec"))).alias(f"__l_{k}") for k in lasts],
    )
    carries = {f"__c_{k}": F.coalesce(F.sum(f"__n_{k}").over(files_before()), F.lit(0)) for k in counts} | {f"__c_{k}": F.last(f"__l_{k}", ignorenulls=True).over(files_before()) for k in lasts}
    files = files.select("file_idx", *[v.alias(k) for k, v in carries.items()])
    here = {k: F.sum(one[k]).over(in_file()) - (F.lit(0) if upto_here else one[k]) for k, (_, upto_here) in counts.items()}
    here |= {k: F.last(f"__v_{k}", ignorenulls=True).over(in_file()) for k in lasts}
    joined = rows.withColumns(here).join(files, "file_idx")
    total = {k: (F.col(k) + F.col(f"__c_{k}")).cast("long") for k in counts} | {k: F.coalesce(k, f"__c_{k}") for k in lasts}
    return joined.withColumns(total).drop(*carries, *[f"__v_{k}" for k in lasts])


def running_count(df: DataFrame, name: str, flag: Column, upto_here: bool = True) -> DataFrame:
    """``name``: how many rows up to this one (or before it) in arrival order have ``flag``."""
    return running(df, {name: (flag, upto_here)}, {})


def indexed(df: DataFrame, name: str, order: list[str], *, parts: int | None = None) -> DataFrame:
    """``df``, written, with ``name``: the 0-based place of each row in the order of the columns ``order``.

    Rows are dealt by ranges of the whole order, which Spark samples, so no value and no outlier makes a task large. They are
    sorted within their range and written with their place there; the ranges' counts, one number for each, give the rest.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")  # the range in the upper bits, the place in the lower 33
    part = F.shiftright("__at", 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    before, starts = 0, []
    for k in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(k, 0)
    start = F.lit(starts or [0])[part.cast("int")]  # one number for each range
    return rows.withColumn(name, (start + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__at")
