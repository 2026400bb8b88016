"""Greedy batches of a file's records: a fold in stored order, a file at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch closes before a record this much later than its first, and after so many rows or bytes.
AGE_US, ROWS, BYTES = 30_000_000, 4096, 4 << 20


def batched(records: DataFrame, size: str, *, age_us: int = AGE_US, rows: int = ROWS, most_bytes: int = BYTES, window_us: int | None = None) -> DataFrame:
    """``file_idx, rec, recv_us, kind, size, batch``: the batch of each record in its file; ``size`` names a column of bytes.

    A batch also closes where the tumbling window of ``window_us`` changes, if there is one.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rec")
        batch, first, held, count, out = 0, None, 0, 0, []
        window = lambda at: (at + 62_135_596_800_000_000) // window_us if window_us else 0  # noqa: E731  counted from the year 1
        for at, n in zip(pdf["recv_us"].tolist(), pdf["size"].tolist(), strict=True):
            if count and (at - first >= age_us or window(at) != window(first)):
                batch, count, held = batch + 1, 0, 0
            if not count:
                first = at
            out.append(batch)
            count, held = count + 1, held + n
            if count >= rows or held >= most_bytes:
                batch, count, held = batch + 1, 0, 0
        return pdf.assign(batch=out)

    source = records.select("file_idx", "rec", "recv_us", "kind", F.col(size).cast("long").alias("size"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.groupBy("file_idx").applyInPandas(fold, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", batch long")


def footers(batches: DataFrame) -> DataFrame:
    """A zone map for each batch: rows, least and most time, whether it holds a gap or a reseed."""
    return batches.groupBy("file_idx", "batch").agg(F.count("*").alias("n"), F.min("recv_us").alias("first_us"), F.max("recv_us").alias("last_us"), F.bool_or(F.col("kind") == "gap").alias("has_gap"), F.bool_or(F.col("kind") == "reseed").alias("has_reseed"))
