"""The feed's operators against DuckDB, literal cases, and themselves in other shapes."""

from __future__ import annotations

import hashlib
import random
import re
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.functions import scalars as X
from seqlake.operators import arrival, canonical, replay, sequence
from seqlake.plans import registry, rendering
from seqlake.sources.fixture import records

SF = "/root/testdata/sf0.001"


def tidy(rows, names):
    return sorted(str([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows), names


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = con.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({registry.SQL[name]})")
    assert tidy([tuple(r) for r in got.select(*names).collect()], names) == tidy(want.fetchall(), names)


def tracked(mode, numbers):
    """What a tracker that looks at one number after another says of each; None is a reseed."""
    top, fresh, out = None, False, []
    for n in numbers:
        if n is None:
            fresh = True
            continue
        if top is None or n == top + 1:
            kind = "none"
        elif n <= top:
            kind = "stale" if fresh else "regression"
        elif fresh:
            kind = "reconnect_gap"
        else:
            kind = "gap" if mode == "contiguous" else "none"
        out.append((n, kind, None if top is None else top + 1))
        top, fresh = n if top is None else max(top, n), False
    return out


@pytest.mark.parametrize("mode", ["contiguous", "monotonic"])
@pytest.mark.parametrize("files", [1, 3])
def test_tracker_equals_a_sequential_one(spark, mode, files):
    """Many short runs of random steps, each a product of its own, over one file and over several."""
    rng = random.Random(files)
    runs = {}
    for k in range(60):
        at, numbers = rng.randrange(10**6), []
        for _ in range(12):
            at = max(0, at + rng.choice([1, 1, 1, 0, -2, 3, 40]))
            numbers += [at]
        runs[f"p{k}"] = numbers
    order = [(p, runs[p][j]) for j in range(12) for p in runs]
    reseeds = {100, 101, 350, 500}
    feed, seen = [], {p: [] for p in runs}
    for j, (p, n) in enumerate(order):
        if j in reseeds:
            feed.append(("reseed", "", None))
            for x in seen.values():
                x.append(None)
        feed.append(("message", p, n))
        seen[p].append(n)
    size = -(-len(feed) // files)
    data = [(i, i // size, i % size, k, p, 1000 + i, None, s, "matches") for i, (k, p, s) in enumerate(feed)]
    rows = spark.createDataFrame(data, "arrival long, file_idx long, rec long, kind string, product string, recv_us long, exch_us long, seq long, channel string")
    got = sequence.classified(rows, mode).orderBy("arrival").collect()
    for p in runs:
        assert [(r.seq, r.anomaly, r.expected) for r in got if r["product"] == p] == tracked(mode, seen[p])


def test_strict_replay_stops_and_wide_one_goes_on(spark):
    v = records(spark, SF)
    strict, wide = replay.replay(v), replay.replay(v, continue_on_gap=True)
    first = wide.discontinuities.first()["i"]
    assert strict.error and strict.delivered.count() == first
    assert wide.error is None and wide.delivered.count() == v.count()
    with pytest.raises(ValueError):
        replay.replay(v, reorder=1)
    with pytest.raises(ValueError):
        replay.replay(v, reorder=0)


def test_digest_is_one_however_it_is_partitioned(spark):
    once = canonical.digest(canonical.lines(replay.ordered(records(spark, SF))))
    again = canonical.digest(canonical.lines(replay.ordered(records(spark, SF).repartition(7))))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    lines = con.sql(f"select line from ({registry.SQL['canonical_lines']}) order by i").fetchall()
    assert once == again == hashlib.sha256("".join(f"{x}\n" for (x,) in lines).encode()).hexdigest()


def test_places_are_dealt_evenly(spark):
    """No range of the order takes much more than its share, though a third of the rows has one key and one is far off."""
    rows = spark.range(9000).selectExpr("case when id % 3 = 0 then 0 when id = 1 then 9000000000000 else id end as k", "id as file_idx")
    got = arrival.indexed(rows, "i", ["k", "file_idx"], parts=6)
    assert [r.i for r in got.orderBy("k", "file_idx").collect()] == list(range(9000))
    assert max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) < 2 * 1500


def exactly(text):
    """The rule, by Python's decimals: digits with at most 18 after a point, in 64 bits, that come out as they went in."""
    if not re.fullmatch(r"-?[0-9]+(\.[0-9]{1,18})?", text, re.ASCII):
        return False
    value = Decimal(text)
    units = int(value.scaleb(-value.as_tuple().exponent))
    return format(value, "f") == text and -(2**63) <= units < 2**63 and not (text[0] == "-" and units == 0)


PLACES = [0, 1, 99_999, 629_000, 2_097_152, 5_999_999, 500_000_000]


def test_figures_of_large_tables(spark):
    """Places whose cubes are no longs."""
    got = {r.arrival: r for r in rendering.figures_text(spark.createDataFrame([(a,) for a in PLACES], "arrival long")).collect()}
    for a in PLACES:
        n = a**3 * 37
        assert got[a]["count"] == f"{n:,}" and (n < 1 << 40 or got[a].bytes == f"{n / 1024**4:.{2 if n < 10 << 40 else 1 if n < 100 << 40 else 0}f} TiB")


def test_durations_of_large_tables(spark):
    got = {r.arrival: r for r in rendering.durations_text(spark.createDataFrame([(a,) for a in PLACES], "arrival long")).collect()}
    for a in PLACES:
        ns = a**3 % 59_999_999_989
        step = next((s for least, s in ((10**9, 10**6), (10**6, 1000), (1000, 10)) if ns >= least), 1)
        assert got[a].elapsed == f"0:00:{ns // 10**9:02}" and got[a].rounded == (ns + step // 2) // step * step


def test_exact_decimals(spark):
    found = set()

    @settings(max_examples=600, deadline=None, database=None)
    @given(st.decimals(allow_nan=False, allow_infinity=False, places=None).map(str) | st.from_regex(r"[+-]?[0-9]{0,20}\.?[0-9]{0,19}(e-?[0-9])?", fullmatch=True) | st.text("0123456789.-+eE ", max_size=6))
    def gather(text):
        found.add(text)

    gather()
    rows = spark.createDataFrame([(x,) for x in sorted(found)], "t string")
    t = F.col("t")
    got = {r.t: r.back for r in rows.select("t", X.decimal_text(X.decimal_units(t), X.decimal_scale(t)).alias("back")).collect()}
    assert got == {x: x if exactly(x) else None for x in found}


def test_stream_equals_batch(spark, tmp_path):
    from seqlake.operators.arrival import running_count
    from seqlake.streaming.tracker import track

    v = records(spark, SF)
    rows = running_count(v, "epoch", F.col("kind") == "reseed").where("kind = 'message' and seq is not null and bad = 0").select("file_idx", "rec", "arrival", "product", "seq", "epoch")
    for part in (0, 1):
        rows.where(f"file_idx = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    for mode in ("contiguous", "monotonic"):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = track(stream, mode).writeStream.format("memory").queryName(f"out_{mode}").option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r.arrival, r.anomaly) for r in spark.table(f"out_{mode}").collect()}
        assert got == {(r.arrival, r.anomaly) for r in sequence.classified(v, mode).collect()}
