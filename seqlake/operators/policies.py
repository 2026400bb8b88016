"""What a bounded queue between a feed and a writer does under each overload policy, as a deterministic simulation.

A queue's state is a fold in order, so a product's records are one task, as they are one queue in a capture. The fold streams
over them: Arrow batches come in order, and only the records that wait are held.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("block", "drop", "buffer")


def simulate(records: DataFrame, policy: str, *, depth: int, service_us: int) -> DataFrame:
    """``arrival, product, kind, recv_us, kept, start_us, queued`` of each record: a writer takes ``service_us`` for one, in order of arrival.

    ``block`` keeps all and makes the feed wait; ``drop`` sheds messages that find ``depth`` records waiting, but never a
    reseed; ``buffer`` keeps all and lets the queue grow. Products have queues of their own.
    """
    if policy not in POLICIES:
        raise ValueError(policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, waiting, last = None, deque(), None
        for b in batches:
            kept, start, queued = [], [], []
            for own, at, kind in zip(b.column("product").to_pylist(), b.column("recv_us").to_pylist(), b.column("kind").to_pylist(), strict=True):
                if own != product:
                    product, waiting, last = own, deque(), None
                while waiting and waiting[0] <= at:
                    waiting.popleft()
                n = len(waiting)
                queued.append(min(n, depth) if policy == "block" else n)
                shed = policy == "drop" and n >= depth and kind == "message"
                kept.append(not shed)
                start.append(None if shed else max(at, last) if last is not None else at)
                if not shed:
                    last = start[-1] + service_us
                    waiting.append(last)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("arrival", "product", "kind", "recv_us")], pa.array(kept), pa.array(start, pa.int64()), pa.array(queued, pa.int64())], names=["arrival", "product", "kind", "recv_us", "kept", "start_us", "queued"])

    rows = records.select("arrival", F.coalesce("product", F.lit("")).alias("product"), "kind", "recv_us")
    dealt = rows.repartition("product").sortWithinPartitions("product", "arrival")
    return dealt.mapInArrow(run, "arrival long, product string, kind string, recv_us long, kept boolean, start_us long, queued long")


def gap_rows(simulated: DataFrame) -> DataFrame:
    """``product, at_us, dropped, next_arrival``: one row for each run of dropped records, before the next kept one.

    It carries the time of the first that was dropped; a run at the end has no next.
    """
    w = Window.partitionBy("product").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = simulated.withColumn("run", F.coalesce(F.sum(F.col("kept").cast("long")).over(w), F.lit(0)))
    dropped = F.when(~F.col("kept"), F.col("recv_us"))
    out = rows.groupBy("product", "run").agg(F.min(dropped).alias("at_us"), F.count(dropped).alias("dropped"), F.min(F.when(F.col("kept"), F.col("arrival"))).alias("next_arrival"))
    return out.where("dropped > 0").drop("run")


def bench_result(simulated: DataFrame) -> DataFrame:
    """``offered, written, dropped, loss, seconds, offered_rate, written_rate, peak_depth`` of a simulated run."""
    one = simulated.agg(F.count("*").alias("offered"), F.sum(F.col("kept").cast("long")).alias("written"), F.max("queued").alias("peak_depth"), ((F.greatest(F.max("recv_us"), F.max("start_us")) - F.min("recv_us")) / 1e6).alias("seconds"))
    rate = lambda n: F.when(F.col("seconds") > 0, F.col(n) / F.col("seconds")).otherwise(0.0)
    loss = F.when(F.col("offered") > 0, (F.col("offered") - F.col("written")) / F.col("offered")).otherwise(0.0)
    return one.withColumns({"dropped": F.col("offered") - F.col("written"), "loss": loss, "offered_rate": rate("offered"), "written_rate": rate("written")})
