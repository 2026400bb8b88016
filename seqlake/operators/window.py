"""A stored window's records with their frames decoded, as the replay takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions.frames import decoded
from seqlake.operators.arrival import running


def window_records(rows: DataFrame) -> DataFrame:
    """Rows of the record log with decoded fields, ``arrival`` (place in stored order) and times as ``exch_us`` and ``recv_us``.

    These two hold nanoseconds here: order needs whole numbers of one unit only. Frames that can't be decoded have ``bad`` 1.
    """
    fields = decoded(rows.repartition("file_idx"))
    message = F.col("kind") == "message"
    named = fields.select(
        "file", F.col("file_idx").cast("long").alias("file_idx"), "rec", "kind", F.col("recv_ns").alias("recv_us"), "recv_ns", "raw", F.when(message, F.col("exch_ns")).alias("exch_us"), F.when(message, F.col("seq")).alias("seq"),
        F.when(message, F.col("channel")).otherwise("control").alias("channel"), F.when(message, F.col("type")).alias("etype"), F.when(message, F.col("product")).otherwise("").alias("product"), "side", "price_text", "size_text",
        "expected", "got", "dropped", "reason", F.when(message & (F.col("decode_error") != ""), 1).otherwise(0).alias("bad"), F.when(message & (F.col("decode_error") != ""), F.col("decode_error")).alias("decode_error"),
    )
    return running(named, {"arrival": (F.lit(True), False)}, {})
