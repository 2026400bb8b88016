"""Capture as a stream: frames in, records with gap rows out, rotated files, interval figures and progress.

A micro-batch is what the queue holds: the source takes a bounded number of frames for each (``block``), or all there are
(``buffer``). ``drop`` sheds what a batch has beyond the queue's depth, never a reseed, and every shed frame is in a gap row.
State is kept by product; reseeds carry no product, so the source stamps their running count on each row as ``epoch``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from seqlake.functions.frames import decode
from seqlake.sources.store import Uploader
from seqlake.streaming.tracker import step

#: Seconds from the year 1, from which windows are counted, to 1970.
ORIGIN_S = 62_135_596_800
RECORDS = "product string, arrival long, sub int, kind string, recv_ns long, raw string, expected long, got long, dropped long, reason string, anomaly string, decode_error string, exch_ns long, error_text string"


class Tracker(StatefulProcessor):
    """A product's high-water mark and the epoch it was last seen in; a gap row goes before each message that reveals one."""

    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mark", "hwm long, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        hwm, seen = self.state.get() if self.state.exists() else (None, 0)
        held = pd.concat(list(rows)).sort_values(["arrival", "sub"])
        out = []
        for r in held.itertuples():
            row = {"product": key[0], "arrival": r.arrival, "sub": 1, "kind": r.kind, "recv_ns": r.recv_ns, "raw": r.raw, "expected": None, "got": None, "dropped": None, "reason": r.reason, "anomaly": None, "decode_error": None, "exch_ns": None, "error_text": None}
            if r.kind == "gap":
                row |= {"sub": 0, "expected": 0, "got": 0, "dropped": int(r.dropped)}
            elif r.kind == "message":
                e = decode((r.raw or "").encode())
                row |= {"decode_error": e["decode_error"] or None, "exch_ns": e["exch_ns"], "error_text": e["error_text"] or None}
                seq = e["seq"]
                if seq is not None and not e["decode_error"]:
                    found = step(self.mode, hwm, r.epoch, seq, seen)
                    row["anomaly"] = found
                    if found not in ("none", "stale"):
                        out.append(row | {"sub": 0, "kind": "gap", "raw": None, "expected": hwm + 1, "got": seq, "dropped": 0, "reason": None, "decode_error": None, "exch_ns": None, "error_text": None})
                    hwm, seen = seq if hwm is None else max(hwm, seq), r.epoch
            out.append(row)
        if hwm is not None:
            self.state.update((int(hwm), int(seen)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
        yield frame.astype({c: "Int64" for c in ("arrival", "recv_ns", "expected", "got", "dropped", "exch_ns")} | {"sub": "int32"})

    def close(self) -> None:
        """Nothing is held outside of the state."""


def tracked(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's records (``arrival, kind, product, epoch, recv_ns, raw, reason, dropped``) with gap rows, decoded and classified."""
    has = set(stream.columns)
    rows = stream.select("product", "arrival", F.when(F.col("kind") == "gap", 0).otherwise(1).alias("sub"), "kind", "epoch", "recv_ns", "raw", "reason", (F.col("dropped") if "dropped" in has else F.lit(None).cast("long")).alias("dropped"))
    return rows.groupBy("product").transformWithStateInPandas(Tracker(mode), RECORDS, "append", "none")


def shed(batch: DataFrame, depth: int) -> DataFrame:
    """A batch without the messages that stand behind ``depth`` others of their product, with one gap row for each run of them.

    The gap row stands where the run's first message was, and has its time.
    """
    w = Window.partitionBy("product").orderBy("arrival")
    place = F.sum((F.col("kind") == "message").cast("int")).over(w)
    rows = batch.withColumn("lost", (F.col("kind") == "message") & (place > depth))
    rows = rows.withColumn("run", F.sum((~F.col("lost")).cast("int")).over(w))
    gaps = rows.where("lost").groupBy("product", "run").agg(F.min("arrival").alias("arrival"), F.min("recv_ns").alias("recv_ns"), F.max("epoch").alias("epoch"), F.count("*").alias("dropped"))
    gaps = gaps.select("arrival", F.lit("gap").alias("kind"), "product", F.lit(None).cast("long").alias("seq"), "epoch", "recv_ns", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("reason"), "dropped")
    kept = rows.where("not lost").drop("lost", "run").withColumn("dropped", F.lit(None).cast("long"))
    return kept.unionByName(gaps.select(*kept.columns))


@dataclass
class Session:
    """What a capture has counted so far, batch by batch; also valid when it ended with an error."""

    records: int = 0
    messages: int = 0
    gaps: int = 0
    reseeds: int = 0
    stale: int = 0
    decode_errors: int = 0
    exchange_errors: int = 0
    dropped: int = 0
    deepest: int = 0
    bytes: int = 0
    warnings: list[str] = field(default_factory=list)

    def add(self, batch: DataFrame) -> None:
        n = lambda cond: F.coalesce(F.sum(F.expr(f"cast(coalesce({cond}, false) as long)")), F.lit(0))
        got = batch.agg(
            F.count("*").alias("records"), n("kind = 'message'").alias("messages"), n("kind = 'gap'").alias("gaps"), n("kind = 'reseed'").alias("reseeds"), n("anomaly = 'stale'").alias("stale"), n("decode_error is not null").alias("decode_errors"),
            n("error_text is not null").alias("exchange_errors"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"),
        ).first()
        for k in got.asDict():
            setattr(self, k, getattr(self, k) + got[k])
        self.deepest = max(self.deepest, got["records"])
        found = batch.where("decode_error is not null or error_text is not null").orderBy(F.desc("arrival")).limit(3).collect()  # the latest three are shown
        self.warnings = [*self.warnings, *[r.decode_error or r.error_text for r in reversed(found)]][-3:]


def interval_rows(batch: DataFrame, interval_ns: int) -> DataFrame:
    """``product, slot, messages, gaps, lag_n, lag_sum, lag_least, lag_most`` of a batch; an absent exchange time is no lag."""
    lag = F.when(F.col("kind") == "message", F.col("recv_ns") - F.col("exch_ns"))
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"{k}s")
    return batch.groupBy("product", F.floor(F.col("recv_ns") / interval_ns).cast("long").alias("slot")).agg(count("message"), count("gap"), F.count(lag).alias("lag_n"), F.sum(lag).alias("lag_sum"), F.min(lag).alias("lag_least"), F.max(lag).alias("lag_most"))


@dataclass
class Publisher:
    """Interval figures to a sink, one call for each interval that has ended; the last, unfinished one when the capture closes.

    An interval stays open until a later one has begun. What a sink refuses is counted and never stops the capture.
    """

    sink: Callable[[int, list[dict]], None]
    interval_ns: int
    open: dict[int, dict[str, dict]] = field(default_factory=dict)
    attempts: list[dict] = field(default_factory=list)

    def add(self, batch: DataFrame) -> None:
        for r in interval_rows(batch, self.interval_ns).collect():  # a row for each product and interval of one batch
            into = self.open.setdefault(r.slot, {}).setdefault(r.product, {"messages": 0, "gaps": 0, "lag_n": 0, "lag_sum": 0, "lag_least": None, "lag_most": None})
            for k in ("messages", "gaps", "lag_n"):
                into[k] += r[k]
            into["lag_sum"] += r.lag_sum or 0
            for k, pick in (("lag_least", min), ("lag_most", max)):
                into[k] = pick(x for x in (into[k], r[k]) if x is not None) if r[k] is not None or into[k] is not None else None
        for slot in sorted(self.open)[:-1]:
            self.publish(slot)

    def publish(self, slot: int) -> None:
        seconds, data = self.interval_ns / 1e9, []
        for product, got in sorted(self.open.pop(slot).items()):
            data += [{"product": product, "name": "Messages", "value": got["messages"]}, {"product": product, "name": "MessageRate", "value": got["messages"] / seconds}, {"product": product, "name": "SequenceGaps", "value": got["gaps"]}]
            if got["lag_n"]:
                data.append({"product": product, "name": "IngestLag", "n": got["lag_n"], "total": got["lag_sum"] / 1e9, "least": got["lag_least"] / 1e9, "most": got["lag_most"] / 1e9})
        ok = True
        try:
            self.sink(slot, data)
        except Exception:  # noqa: BLE001  a dead sink must not end a capture
            ok = False
        self.attempts.append({"slot": slot, "datapoints": len(data), "ok": ok})

    def close(self) -> None:
        for slot in sorted(self.open):
            self.publish(slot)


@dataclass
class TableSink:
    """A publisher's sink that appends an interval's datapoints to a Parquet table, one folder for each interval.

    A set of statistics without observations is left out. An interval that is published again replaces its own folder.
    """

    spark: SparkSession
    path: str
    SCHEMA = "product string, name string, value double, n long, total double, least double, most double"

    def __call__(self, slot: int, data: list[dict]) -> None:
        names = [x.split()[0] for x in self.SCHEMA.split(", ")]
        number = lambda v: float(v) if v is not None else None
        rows = [tuple(d.get(c) if c in ("product", "name", "n") else number(d.get(c)) for c in names) for d in data if d.get("value") is not None or d.get("n")]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/slot={slot}")


class Progress(StreamingQueryListener):
    """A bounded list of samples of how a query goes on: rows and rates of each trigger, the oldest let go."""

    def __init__(self, most: int = 256):
        self.most, self.samples, self.ended = most, [], []

    def onQueryStarted(self, event) -> None:
        """A start says nothing to sample."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.samples = [*self.samples, {"batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond}][-self.most :]

    def onQueryIdle(self, event) -> None:
        """Nor does idling."""

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)


@dataclass
class Capture:
    """A running capture: the query, what it has counted, and how to end it in order."""

    query: StreamingQuery
    session: Session
    publisher: Publisher | None
    uploader: Uploader | None

    def finish(self, seconds: int | None = None) -> Session:
        """Wait for what there is (or ``seconds``), stop, publish the last interval, upload what waits; the counts hold in any case."""
        try:
            if seconds is None:
                self.query.processAllAvailable()
            else:
                self.query.awaitTermination(seconds)
        finally:
            with contextlib.suppress(Exception):
                self.query.stop()
            if self.publisher:
                self.publisher.close()
            if self.uploader:
                self.uploader.close()
        return self.session


def capture(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "contiguous", policy: str = "block", depth: int = 4096, window_s: int = 300, trigger: dict | None = None, publisher: Publisher | None = None, uploader: Uploader | None = None) -> Capture:
    """Write a feed's records to Parquet below ``path`` by ``symbol`` and ``window`` (start of the tumbling window in seconds).

    Each micro-batch is a folder of its own, ``batch=n``: one that is run again after a failure replaces its own folder and no
    other, so nothing stored is rewritten and nothing is doubled. ``policy`` ``drop`` sheds messages beyond ``depth`` a batch.
    """
    if policy not in ("block", "drop", "buffer"):
        raise ValueError(policy)
    session = Session()

    def sink(batch: DataFrame, n: int) -> None:
        second = F.floor(F.col("recv_ns") / 1_000_000_000)
        start = second - F.pmod(second + F.lit(ORIGIN_S), F.lit(window_s))
        rows = batch.withColumn("window", start.cast("long")).withColumn("symbol", F.when(F.col("product") == "", "_feed").otherwise(F.col("product")))
        rows.repartition("symbol", "window").sortWithinPartitions("arrival", "sub").write.mode("overwrite").partitionBy("symbol", "window").parquet(f"{path}/batch={n}")
        stored = batch.sparkSession.read.schema(rows.drop("symbol", "window").schema).parquet(f"{path}/batch={n}")
        session.add(stored)
        if publisher:
            publisher.add(stored)

    source = stream
    if policy == "drop":
        # Shedding looks at a whole batch, so it comes before the state in the same trigger.
        return _dropping(stream, path, checkpoint, mode, depth, sink, session, trigger, publisher, uploader)
    query = tracked(source, mode).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return Capture(query, session, publisher, uploader)


def _dropping(stream: DataFrame, path: str, checkpoint: str, mode: str, depth: int, sink, session: Session, trigger, publisher, uploader) -> Capture:
    """Shed in one query, into a folder of kept frames and gap rows, which a second one tracks."""
    spark, kept = stream.sparkSession, f"{path}/_kept"
    schema = None

    def keep(batch: DataFrame, n: int) -> None:
        shed(batch, depth).coalesce(1).sortWithinPartitions("arrival").write.mode("overwrite").parquet(f"{kept}/batch={n}")

    first = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/shed").trigger(**(trigger or {"availableNow": True})).start()
    first.awaitTermination() if trigger is None else first.processAllAvailable()
    first.stop()
    schema = spark.read.parquet(f"{kept}/batch=0").schema
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(kept)
    query = tracked(files, mode).writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/track").trigger(availableNow=True).start()
    return Capture(query, session, publisher, uploader)
