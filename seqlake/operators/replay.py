"""Replay: pinned keys, one total order, discontinuities and where a strict reader stops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.arrival import indexed, running

KEY = ["k_exch", "k_rank", "k_seq", "k_channel"]
ORDER = [*KEY, "file_idx", "rec"]


def annotated(records: DataFrame) -> DataFrame:
    """The records with their order key, ``opening`` (a reseed that no message came before) and ``epoch`` (reseeds up to here).

    The key is a record's own if it is a message with an exchange time, else that of the last such one in arrival order.
    """
    kind = F.col("kind")
    own = F.when((kind == "message") & F.col("exch_us").isNotNull(), F.struct(F.col("exch_us").alias("k_exch"), F.when(F.col("seq").isNull(), 0).otherwise(1).alias("k_rank"), F.coalesce("seq", F.lit(0)).cast("long").alias("k_seq"), F.col("channel").alias("k_channel")))
    rows = running(records, {"epoch": (kind == "reseed", True), "__messages": (kind == "message", False)}, {"__key": own})
    zero = {"k_exch": F.lit(0).cast("long"), "k_rank": F.lit(0), "k_seq": F.lit(0).cast("long"), "k_channel": F.lit("")}
    return rows.withColumns({k: F.coalesce(F.col(f"__key.{k}"), v) for k, v in zero.items()} | {"opening": (kind == "reseed") & (F.col("__messages") == 0)}).drop("__key", "__messages")


def ordered(records: DataFrame) -> DataFrame:
    """The replay: every record with its key, ``opening``, ``i`` (place in the total order) and ``disc`` (a discontinuity)."""
    rows = annotated(records)
    return indexed(rows.withColumn("disc", (F.col("kind") == "gap") | ((F.col("kind") == "reseed") & ~F.col("opening"))), "i", ORDER)


def until_gap(replay: DataFrame) -> DataFrame:
    """What a strict reader delivers: the records before the first discontinuity."""
    first = replay.where("disc").agg(F.min("i")).first()[0]
    return replay if first is None else replay.where(F.col("i") < first)


@dataclass
class Replay:
    """A replayed window: what is delivered, every discontinuity, and the error that stopped a strict reader."""

    delivered: DataFrame
    discontinuities: DataFrame
    error: str | None


def replay(records: DataFrame, *, continue_on_gap: bool = False, reorder: int = 4096) -> Replay:
    """Replay a window. A record may come ``reorder`` places late at most; more is an error, raised before anything is delivered."""
    if reorder <= 0:
        raise ValueError("the reorder window must be positive")
    rows = ordered(records)
    needed = required_window(rows).first()[0]
    if needed is not None and needed > reorder:
        raise ValueError(f"records come out of order by more than {reorder} places: {needed} are needed")
    found = rows.where("disc").orderBy("i")
    first = found.limit(1).collect()
    if not first or continue_on_gap:
        return Replay(rows.orderBy("i"), found, None)
    return Replay(rows.where(F.col("i") < first[0]["i"]).orderBy("i"), found, f"discontinuity ({first[0]['kind']}) at file {first[0]['file_idx']}, record {first[0]['rec']}")


def required_window(replay: DataFrame) -> DataFrame:
    """``n``: the least number of buffered records that a bounded heap needs to give the same order."""
    return replay.agg((F.max(F.col("arrival") - F.col("i")) + 1).alias("n"))
