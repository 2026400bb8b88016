from __future__ import annotations

from seqlake.functions.frames import decode, decoded
from seqlake.operators.batches import batched, footers


def test_decode_cases():
    good = decode(b'{"type":"match","product_id":"XY","sequence":31,"time":"2031-02-03T04:05:06.000070809Z","price":"17.250","size":"4e-3","side":"sell"}')
    assert (good["channel"], good["seq"], good["price_text"], good["size"], good["decode_error"]) == ("matches", 31, "17.250", 0.004, "")
    assert good["exch_ns"] % 10**9 == 70809
    for bad in (b"", b"{", b'{"type":"match","price":3}', b'{"sequence":-4}', b'{"sequence":"4"}', b'{"x":NaN}', b"\xfe", b"[" * 200000, b'{"type":false}', "{}".encode("utf-16")):
        assert decode(bad)["decode_error"] and decode(bad)["channel"] == ""
    late = decode(b'{"type":"match","sequence":4,"time":"noon","price":"2"}')
    assert late["decode_error"] and late["seq"] == 4 and late["exch_ns"] is None and late["price"] == 0.0
    for price in ("dear", "3e999", "inf", "nan", "1_0", "0x1p2"):
        priced = decode(b'{"type":"match","time":"2031-02-03T04:05:06Z","price":"%s","size":"2"}' % price.encode())
        assert priced["decode_error"] and priced["exch_ns"] is not None and priced["size"] == priced["price"] == 0.0
    assert decode(b'{"TYPE":"error","message":"closed","reason":"late"}')["error_text"] == "closed: late"


def test_decoded_rows(spark):
    rows = decoded(spark.createDataFrame([(1, bytearray(b'{"type":"l2update"}')), (2, None)], "id long, raw binary")).orderBy("id").collect()
    assert [(r.id, r.channel, r.exch_ns, r.seq) for r in rows] == [(1, "level2_batch", None, None), (2, "", None, None)]


def test_batches(spark):
    near = spark.createDataFrame([(0, i, i * 1_000_000, "message", 10) for i in range(20)] + [(1, i, i * 7_500_000, "message", 10) for i in range(40)] + [(2, i, 0, "gap" if i == 7 else "message", 10) for i in range(4148)], "file_idx long, rec long, recv_us long, kind string, n long")
    found = footers(batched(near, "n")).groupBy("file_idx").count().collect()
    assert {r.file_idx: r["count"] for r in found} == {0: 1, 1: 10, 2: 2}
    cut = footers(batched(near.where("file_idx = 0"), "n", window_us=5_000_000)).orderBy("batch").collect()
    assert [(r.n, r.first_us) for r in cut] == [(5, 0), (5, 5_000_000), (5, 10_000_000), (5, 15_000_000)]
