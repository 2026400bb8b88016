"""Capture of a synthetic stream: gap rows, epochs, policies, figures, recovery."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlake.operators import sequence
from seqlake.sources.synthetic import SyntheticFeed
from seqlake.streaming import capture as C

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def feed(spark):
    spark.dataSource.register(SyntheticFeed)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield lambda **o: spark.readStream.format("synthetic").options(**{k: str(v) for k, v in o.items()}).load()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def stored(spark, path):
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in range(99) if (C_exists(path, n))])


def C_exists(path, n):
    import os

    return os.path.isdir(f"{path}/batch={n}")


@pytest.mark.parametrize("mode", ["contiguous", "monotonic"])
def test_stream_equals_batch_and_counts_hold(spark, feed, tmp_path, mode):
    """Batches of 70 frames, two products, lost numbers, two new connections: as the batch tracker has it."""
    published = []
    publisher = C.Publisher(lambda slot, data: published.append((slot, data)), interval_ns=50 * 10**6)
    stream = feed(count=400, batch=70, skip_after="100:5,257:2", sever_after="180,300")
    progress = C.Progress(most=3)
    spark.streams.addListener(progress)
    run = C.capture(stream, str(tmp_path / "out"), str(tmp_path / "ck"), mode=mode, trigger={"processingTime": "0 seconds"}, publisher=publisher)
    session = run.finish()
    for _ in range(100):
        if not progress.ended:
            time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert 0 < len(progress.samples) <= 3 and progress.ended == [None] and all(s["rows"] >= 0 for s in progress.samples)
    rows = stored(spark, str(tmp_path / "out"))
    messages = rows.where("kind = 'message'")
    assert (messages.count(), session.messages, session.reseeds) == (400, 400, 3) and session.records == rows.count()
    flat = rows.where("kind <> 'gap'").select("arrival", F.lit(0).cast("long").alias("file_idx"), F.col("arrival").alias("rec"), "kind", "product", (F.col("recv_ns") / 1000).cast("long").alias("recv_us"), F.regexp_extract(F.coalesce("raw", F.lit("")), r'"sequence":(\d+)', 1).try_cast("long").alias("seq"))
    want = {(r.arrival, r.anomaly, r.expected) for r in sequence.classified(flat, mode).where("anomaly not in ('none', 'stale')").collect()}
    got = {(r.arrival, r.anomaly, r.expected) for r in rows.where("kind = 'gap'").collect()}
    assert got == want and len(want) == (4 if mode == "contiguous" else 0)
    assert sum(d["value"] for _, data in published for d in data if d["name"] == "Messages") == 400
    assert [s for s, _ in published] == sorted({s for s, _ in published}) and all(a["ok"] for a in publisher.attempts)


def test_restart_goes_on_where_it_was(spark, feed, tmp_path):
    stream = feed(count=300, batch=60)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    first = C.capture(stream, out, ck, trigger={"processingTime": "0 seconds"})
    first.query.processAllAvailable()
    first.query.stop()
    n = stored(spark, out).count()
    again = C.capture(feed(count=500, batch=60), out, ck, trigger={"processingTime": "0 seconds"})
    again.finish()
    rows = stored(spark, out)
    assert n == 301 and rows.count() == 501 and rows.where("kind = 'gap'").count() == 0
    assert rows.select("arrival").distinct().count() == 501


def test_shed_frames_are_in_gap_rows(spark, feed, tmp_path):
    run = C.capture(feed(count=400, batch=100, sever_after="150"), str(tmp_path / "out"), str(tmp_path / "ck"), policy="drop", depth=30, trigger={"processingTime": "0 seconds"})
    session = run.finish()
    rows = stored(spark, str(tmp_path / "out"))
    told = rows.where("kind = 'gap'").agg(F.sum("dropped")).first()[0]
    assert session.messages + told == 400 and session.dropped == told == 160 and rows.where("kind = 'reseed'").count() == 2
    kinds = [r.kind for r in rows.where("product = 'S0'").orderBy("arrival", "sub").collect()]
    assert "gap" in kinds and kinds.index("gap") == 30


def test_damaged_frames_are_kept_and_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "message", "P", 1, 5, '{"type":"error","message":"no"}', None), (2, "message", "P", 1, 6, "{", None)], "arrival long, kind string, product string, epoch long, recv_ns long, raw string, reason string")
    session = C.Session()
    session.add(rows.select(*rows.columns, F.lit(None).cast("string").alias("anomaly"), F.when(F.col("raw") == "{", "broken").alias("decode_error"), F.when(F.col("arrival") == 1, "no").alias("error_text"), F.lit(None).cast("long").alias("dropped")))
    assert (session.decode_errors, session.exchange_errors, session.warnings) == (1, 1, ["no", "broken"])
    sink = C.TableSink(spark, str(tmp_path / "m"))
    sink(7, [{"product": "P", "name": "Messages", "value": 3}, {"product": "P", "name": "IngestLag", "n": 0}])
    sink(7, [{"product": "P", "name": "Messages", "value": 4}, {"product": "P", "name": "IngestLag", "n": 2, "total": 3.0, "least": 1.0, "most": 2.0}])
    assert [(r.slot, r.name, r.value, r.n) for r in spark.read.parquet(sink.path).orderBy("name").collect()] == [(7, "IngestLag", None, 2), (7, "Messages", 4.0, None)]
    failing = C.Publisher(lambda slot, data: 1 / 0, 10)
    failing.open = {1: {"P": {"messages": 1, "gaps": 0, "lag_n": 0, "lag_sum": 0, "lag_least": None, "lag_most": None}}}
    failing.close()
    assert Counter(a["ok"] for a in failing.attempts) == {False: 1}
    with pytest.raises(ValueError):
        C.capture(rows, "x", "y", policy="none")
