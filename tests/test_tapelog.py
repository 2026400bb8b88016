"""Record logs: both formats, mixed windows, damage, partitions, the writer, the uploader."""

from __future__ import annotations

import gzip
import io
import random
from collections import Counter
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.functions.bits import crc32c
from seqlake.operators.storage import census, storage_profile, totals
from seqlake.sources import columnar, tapefile
from seqlake.sources.hadoop import read_window
from seqlake.sources.records import Record, exact
from seqlake.sources.store import Store, Taken, Uploader, backoff, valid_symbol

SECOND = 10**9
TEXT = st.text(max_size=8)
U64 = st.integers(0, 2**64 - 1)
FRAME = st.builds(
    lambda t, p, q, at, side, price, size: ('{"type":%s,"product_id":"%s"%s%s,"side":"%s","price":"%s","size":"%s"}' % ('"match"' if t else '"l2update"', p, f',"sequence":{q}' if q is not None else "", f',"time":"2033-01-0{at}T00:00:00.{at}Z"' if at else "", side, price, size)).encode(),
    st.booleans(), st.sampled_from(["", "A", "B-C"]), st.none() | U64, st.integers(0, 9), st.sampled_from(["", "buy", "sell", "cross"]), st.sampled_from(["", "1.50", "-0.25", "1e3", "0012", "99999999999999999999"]), st.sampled_from(["", "0.00000001", "7"]),
)
RECORD = st.one_of(
    st.builds(lambda at, raw: Record("message", at, raw=raw), st.integers(-(2**62), 2**62), FRAME | st.binary(max_size=20)),
    st.builds(lambda at, a, b, n: Record("gap", at, expected=a, got=b, dropped=n), st.integers(-(2**62), 2**62), U64, U64, U64),
    st.builds(lambda at, why: Record("reseed", at, reason=why), st.integers(-(2**62), 2**62), TEXT),
)


@settings(max_examples=120, deadline=None)
@given(st.lists(RECORD, min_size=1, max_size=40), st.sampled_from(tapefile.VERSIONS))
def test_files_give_their_records_back(records, version):
    data = tapefile.to_bytes(records, version)
    assert list(tapefile.read_records(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(tapefile.read_records(io.BytesIO(data[:-1])))


@settings(max_examples=150, deadline=None)
@given(st.lists(U64, max_size=30), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30))
def test_numbers(unsigned, signed):
    assert columnar.from_varints(columnar.to_varints(unsigned)).tolist() == unsigned
    assert columnar.unzigzag(columnar.zigzag(signed)).tolist() == signed
    assert columnar.summed(columnar.steps(signed)).tolist() == signed


def test_checksum_of_a_bit_by_bit_one():
    for n in (0, 1, 7, 8, 9, 64, 1001, 1 << 14, 20011):
        data, crc = random.Random(n).randbytes(n), 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        assert crc32c(data) == crc ^ 0xFFFFFFFF


def sample(n: int, start: int = 0) -> list[Record]:
    rng = random.Random(n + start)
    out = []
    for i in range(n):
        at = (start + i) * SECOND // 4
        if i % 37 == 11:
            out.append(Record("gap", at, expected=i, got=i + 3, dropped=i % 2))
        elif i % 41 == 0:
            out.append(Record("reseed", at, reason=f"again {i}"))
        elif i % 29 == 5:
            out.append(Record("message", at, raw=b'{"type":"match","price":4}'))
        else:
            out.append(Record("message", at, raw=b'{"type": "match","sequence":%d,"price":"%d.%02d","size":"0.5","side":"buy","time":"2033-01-01T00:00:%02d.5Z"}' % (i, rng.randrange(900), rng.randrange(100), i % 60)))
    return out


def test_every_flipped_byte_is_noticed():
    records = sample(24)
    data = tapefile.to_bytes(records, columnar.VERSION)
    for at in range(len(data)):
        with pytest.raises(ValueError):
            list(tapefile.read_records(io.BytesIO(data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :])))
            assert at in (6, 7)  # the header's reserved bytes say nothing
            raise ValueError


def test_batches_close_by_the_records_alone():
    rows = [Record("message", i * SECOND, raw=b"x") for i in range(100)]
    assert [len(b) for b in columnar.batches(iter(rows))] == [30, 30, 30, 10]
    assert [len(b) for b in columnar.batches(iter([replace(r, recv_ns=0) for r in rows] * 50))] == [4096, 904]
    assert [len(b) for b in columnar.batches(iter(Record("message", 0, raw=bytes(1 << 20)) for _ in range(9)))] == [4, 4, 1]


def window(tmp_path) -> dict[str, list[Record]]:
    files = {f"v1/symbol={s}/date=2033-01-0{d}/hour=0{h}/a.tape": sample(150 + 10 * h, d * 1000 + h * 100) for s in ("A", "B") for d in (1, 2) for h in (0, 1)}
    for i, (key, records) in enumerate(files.items()):
        Store(str(tmp_path)).put(key, tapefile.to_bytes(records, tapefile.VERSIONS[i % 2]))
    return files


def test_windows_of_both_formats(spark, tmp_path):
    files = window(tmp_path)
    spark.dataSource.register(tapefile.TapeSource)
    got = spark.read.format("tapelog").load(str(tmp_path)).collect()
    assert len(got) == sum(map(len, files.values()))
    for r in got:
        own = files[r.file][r.rec]
        assert (r.kind, r.recv_ns, None if r.raw is None else bytes(r.raw), r.reason) == (own.row()[0], own.row()[1], own.row()[2], own.row()[6])
        assert [None if v is None else int(v) for v in (r.expected, r.got, r.dropped)] == list(own.row()[3:6])
        assert r.file_idx == [k for k in files if f"symbol={r.symbol}/" in k].index(r.file)
    part = spark.read.format("tapelog").option("symbol", "B").option("hour", "01").load(str(tmp_path))
    assert {(r.symbol, r.hour, r.file_idx) for r in part.select("symbol", "hour", "file_idx").distinct().collect()} == {("B", "01", 1), ("B", "01", 3)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pruned = spark.read.format("tapelog").option("pushdown", "true").load(str(tmp_path)).where("symbol = 'A' and hour = '00' and recv_ns > 0")
    assert {r.file_idx for r in pruned.select("file_idx").distinct().collect()} == {0, 2} and pruned.rdd.getNumPartitions() == 2
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    single = spark.read.format("tapelog").load(str(tmp_path / next(iter(files))))
    assert single.count() == 150
    for bad in ({"symbol": "C"}, {}):
        with pytest.raises(Exception, match="no .tape file"):
            spark.read.format("tapelog").options(**bad).load(str(tmp_path if bad else tmp_path / "none")).count()


def test_windows_through_hadoop(spark, tmp_path):
    """The same rows through Spark's own file systems."""
    window(tmp_path / "deep" / "root")
    spark.dataSource.register(tapefile.TapeSource)
    plain = lambda df: Counter(str(tuple(r)) for r in df.collect())
    own = spark.read.format("tapelog").load(str(tmp_path / "deep" / "root"))
    for root in (str(tmp_path / "deep" / "root"), f"file://{tmp_path}/deep/root/"):
        assert plain(read_window(spark, root)) == plain(own)
    assert plain(read_window(spark, f"file://{tmp_path}/deep/root", symbol="B", hour="01")) == plain(own.where("symbol = 'B' and hour = '01'"))
    with pytest.raises(FileNotFoundError):
        read_window(spark, str(tmp_path / "deep"), symbol="C")


def test_index_footers_and_profile(spark, tmp_path):
    files = {k: v for k, v in window(tmp_path).items()}
    spark.dataSource.register(tapefile.TapeSource)
    load = lambda mode, where=tmp_path: spark.read.format("tapelog").option("mode", mode).load(str(where))
    columns = tmp_path / "two"
    for key, records in files.items():
        Store(str(columns)).put(key, tapefile.to_bytes(records, columnar.VERSION))
    from seqlake.functions.frames import decode

    for r in load("index", columns).collect():
        own = files[r.file][r.rec]
        want = decode(own.raw) if own.kind == "message" else {"decode_error": "no frame"}
        want = {} if want["decode_error"] else want
        assert (r.type, r.exch_ns, r.side or "", r.price_text or "") == (want.get("type", ""), want.get("exch_ns"), want.get("side", ""), want.get("price_text", ""))
        assert (None if r.seq is None else int(r.seq)) == want.get("seq")
    feet = load("footers", columns).orderBy("file", "batch").collect()
    for key, records in files.items():
        mine = [f for f in feet if f.file == key]
        assert sum(f.rows for f in mine) == len(records) and [f.rec for f in mine] == [sum(x.rows for x in mine[:i]) for i in range(len(mine))]
        for f in mine:
            own = records[f.rec : f.rec + f.rows]
            assert (f.first_ns, f.last_ns, f.has_gap, f.has_reseed) == (min(r.recv_ns for r in own), max(r.recv_ns for r in own), any(r.kind == "gap" for r in own), any(r.kind == "reseed" for r in own))
    profiles = load("profile", tmp_path)
    one = totals(profiles).first()
    assert (one.files, one.records) == (16, 2 * sum(map(len, files.values())))
    assert one.frame_bytes == 2 * sum(len(r.raw) for v in files.values() for r in v)
    assert {r.version: r.files for r in census(profiles).collect()} == {1: 4, 2: 12}
    table = storage_profile(profiles).collect()
    assert [(r.stored, r.name) for r in table] == sorted([(r.stored, r.name) for r in table], key=lambda x: (-x[0], x[1]))
    assert abs(sum(r.share for r in table) + one.framing / one.columnar - 1) < 1e-9


@pytest.mark.parametrize("version", tapefile.VERSIONS)
def test_writer_rotates_and_never_overwrites(spark, tmp_path, version):
    spark.dataSource.register(tapefile.TapeSource)
    records = [(s, *r.row()) for s in ("A", "B") for r in sample(400)]
    schema = "symbol string, kind string, recv_ns long, raw binary, expected decimal(20,0), got decimal(20,0), dropped decimal(20,0), reason string"
    from decimal import Decimal

    rows = spark.createDataFrame([tuple(Decimal(v) if 4 <= i <= 6 and v is not None else v for i, v in enumerate(r)) for r in records], schema)
    dealt = rows.withColumn("w", F.floor(F.col("recv_ns") / (30 * SECOND))).repartition(5, "symbol", "w").sortWithinPartitions("symbol", "recv_ns").drop("w")
    write = lambda df: df.write.format("tapelog").mode("append").options(version=version, window_ns=30 * SECOND).save(str(tmp_path))
    write(dealt)
    keys = Store(str(tmp_path)).list()
    assert len(keys) == 8 and keys[1] == "v1/symbol=A/date=1970-01-01/hour=00/19700101T000030Z.tape"
    got = spark.read.format("tapelog").load(str(tmp_path))
    plain = lambda df: Counter(str(tuple(r)) for r in df.select(*rows.columns).collect())
    assert plain(got) == plain(rows)
    with pytest.raises(Exception, match="Taken|tape"):
        write(dealt)
    assert plain(spark.read.format("tapelog").load(str(tmp_path))) == plain(rows) and not Store(str(tmp_path)).list("_staged")
    apart = rows.where("symbol = 'A'").withColumn("symbol", F.lit("C")).coalesce(1).sortWithinPartitions(F.col("recv_ns") % 7)
    with pytest.raises(Exception, match="closed before"):
        write(apart)
    for bad in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            valid_symbol(bad)


def test_uploads(tmp_path):
    source = tmp_path / "f"
    source.write_bytes(b"12345")
    store = Store(str(tmp_path / "store"))
    store.put("old", b"x")
    with pytest.raises(Taken):
        store.put("old", b"y")
    waits = []
    up = Uploader(store, queue=3, attempts=3, sleep=waits.append)
    assert [up.add(str(source), "new"), up.add(str(source), "old"), up.add(str(tmp_path / "gone"), "never"), up.add(str(source), "late")] == [True, True, True, False]
    up.drain()
    assert Counter(e["outcome"] for e in up.events) == {"uploaded": 1, "existed": 1, "failed": 1, "dropped": 1}
    assert len(waits) == 2 and 0.25 <= waits[0] <= 0.5 <= waits[1] <= 1.0 and store.list() == ["new", "old"]
    assert backoff(1, 8, 10, lambda: 0.0) == 4 and backoff(1, 8, 0, lambda: 1.0) == 1


def test_stores_elsewhere_and_uploads_beside(tmp_path):
    """A file system that is no local disk; a thread that uploads while files are added."""
    from pyarrow import fs

    store = Store("bucket", fs._MockFileSystem())
    store.put("v1/symbol=A/b.tape", b"1")
    with pytest.raises(Taken):
        store.put("v1/symbol=A/b.tape", b"2")
    store.put("v1/symbol=A/a.tape", b"22")
    assert store.list("v1/") == ["v1/symbol=A/a.tape", "v1/symbol=A/b.tape"] and store.list("v2/") == [] and store.size("v1/symbol=A/a.tape") == 2
    with store.open("v1/symbol=A/b.tape") as f:
        assert f.read() == b"1"
    up = Uploader(Store(str(tmp_path / "s")))
    up.start()
    for i in range(5):
        (tmp_path / str(i)).write_bytes(bytes([i]))
        assert up.add(str(tmp_path / str(i)), f"k{i}")
    up.close()
    assert Counter(e["outcome"] for e in up.events) == {"uploaded": 5} and not up.waiting


def test_transcoded_and_unpacked_windows(tmp_path):
    files = {f"v1/symbol=A/{i}.tape": sample(80, i) for i in range(3)}
    rows, columns, packed, out = (Store(str(tmp_path / n)) for n in ("rows", "columns", "packed", "out"))
    for key, records in files.items():
        rows.put(key, tapefile.to_bytes(records, 1))
        packed.put(f"{key}.gz", gzip.compress(tapefile.to_bytes(records, 1)))
    assert tapefile.transcode(rows, columns) == tapefile.materialize(packed, out) == sorted(files)
    for key, records in files.items():
        for store in (columns, out):
            with store.open(key) as f:
                assert list(tapefile.read_records(io.BytesIO(f.read()))) == records
    with pytest.raises(Taken):
        tapefile.transcode(rows, columns)


@given(st.from_regex(r"-?[0-9]{0,21}(\.[0-9]{0,20})?", fullmatch=True))
def test_exact(text):
    found = exact(text)
    if found is not None:
        assert columnar.decimal_text(*found) == text
