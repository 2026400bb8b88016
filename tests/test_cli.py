"""The commands end to end, and one window in three formats that must replay alike."""

from __future__ import annotations

import hashlib
import json

import pytest

from seqlake.cli import main
from seqlake.operators import canonical, replay
from seqlake.operators.window import window_records
from seqlake.sources import tapefile
from seqlake.sources.records import Record
from seqlake.sources.store import Store

SECOND = 10**9


def files():
    """Three files: frames out of order within and across files, a damaged one, bytes that are no UTF-8, gaps, reseeds."""
    frame = lambda at, seq, extra="": b'{"type":"match", "product_id":"P","sequence":%d,"time":"2033-01-01T00:%02d:%02d.000000007Z","price":"1.50","size":"2e-7"%s}' % (seq, at // 60, at % 60, extra.encode())
    order = [3, 1, 2, 6, 5, 4, 9, 8, 7, 12, 10, 11]
    out = {}
    for k in range(3):
        rows = [Record("reseed", k * 60 * SECOND, reason="hello \"you\" " if k == 0 else "again")] if k != 1 else []
        rows += [Record("message", (k * 60 + i) * SECOND, raw=frame(s * 5, s)) for i, s in enumerate(order[4 * k : 4 * k + 4])]
        rows += [Record("message", (k * 60 + 20) * SECOND + 1, raw=[b'{"type":"match","price":1}', b"\xff\xfe", b'{"type":"l2update","time":"soon"}'][k])]
        rows += [Record("gap", (k * 60 + 30) * SECOND, expected=5, got=9), Record("gap", (k * 60 + 31) * SECOND, dropped=4)] if k == 1 else []
        out[f"v1/symbol=P/date=2033-01-01/hour=00/20330101T00{k:02d}00Z.tape"] = rows
    return out


@pytest.fixture
def windows(tmp_path):
    for name, versions in (("raw", (1, 1, 1)), ("columnar", (2, 2, 2)), ("mixed", (1, 2, 1))):
        for (key, rows), version in zip(files().items(), versions, strict=True):
            Store(str(tmp_path / name)).put(key, tapefile.to_bytes(rows, version))
    return tmp_path


def sequential() -> list[str]:
    """The replay by hand: each record's key is its own or the last one's before it; then one sort."""
    from seqlake.functions.frames import decode

    key, rows, seen = (0, 0, 0, ""), [], False
    for f, (name, records) in enumerate(files().items()):
        for rec, r in enumerate(records):
            opening = r.kind == "reseed" and not seen
            if r.kind == "message":
                seen, e = True, decode(r.raw)
                if e["exch_ns"] is not None:
                    key = (e["exch_ns"], int(e["seq"] is not None), e["seq"] or 0, e["channel"])
            rows.append((key, f, rec, name, r, opening))
    rows.sort(key=lambda x: x[:3])
    return [canonical.line(r.kind, i, name, rec, r.recv_ns, r.raw, r.expected, r.got, r.dropped, r.reason, opening) for i, (_, _, rec, name, r, opening) in enumerate(rows)]


def test_formats_replay_alike(spark, windows, capsys):
    spark.dataSource.register(tapefile.TapeSource)
    want = sequential()
    for name in ("raw", "columnar", "mixed"):
        got = replay.replay(window_records(spark.read.format("tapelog").load(str(windows / name))), continue_on_gap=True)
        assert [r.line for r in canonical.lines(got.delivered).orderBy("i").collect()] == want
    assert all(json.loads(x) for x in want) and sum('"raw_b64"' in x for x in want) == 1
    assert main(["verify", str(windows / "mixed"), "--chart", "--width", "20"]) == 1
    said = capsys.readouterr().out
    assert hashlib.sha256("".join(x + "\n" for x in want).encode()).hexdigest() in said and "capture dropped 4 frames" in said and "(4 missing)" in said


def test_commands(spark, windows, tmp_path, capsys):
    out = tmp_path / "lines"
    assert main(["replay", str(windows / "raw"), "-o", str(out)]) == 1
    assert out.read_text().splitlines() == sequential()[: len(out.read_text().splitlines())] and "discontinuity" in capsys.readouterr().err
    assert main(["replay", str(windows / "raw"), "--continue-on-gap", "-o", str(out)]) == 0 and out.read_text().splitlines() == sequential()
    assert main(["replay", str(windows / "raw"), "--continue-on-gap", "--pretty", "--quiet"]) == 0
    assert main(["stat", str(windows / "mixed")]) == 0 and "2 v1, 1 v2" in capsys.readouterr().out
    assert main(["bench", str(windows / "raw"), "--repeat", "3", "--buffer", "2", "--service-us", "3000000"]) == 0 and capsys.readouterr().out.count("offered 45") == 3
    assert main(["replay", str(tmp_path / "none")]) == 1 and "holds no" in capsys.readouterr().err
    assert main(["replay", str(windows / "raw"), "--reorder", "1", "--continue-on-gap", "--quiet"]) == 1
    with pytest.raises(SystemExit) as e:
        main(["replay"])
    assert e.value.code == 2


def test_capture_then_verify(spark, tmp_path, capsys):
    assert main(["capture", str(tmp_path / "w"), "--count", "300", "--buffer", "80", "--skip-after", "100:4", "--format", "raw"]) == 0
    capsys.readouterr()
    assert main(["verify", str(tmp_path / "w")]) == 1
    said = capsys.readouterr().out
    assert "messages 300" in said and "gaps 2" in said and "reseeds 1" in said
