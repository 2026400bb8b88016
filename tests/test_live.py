"""The live feed against a small server on this machine."""

from __future__ import annotations

import base64
import hashlib
import itertools
import socket
import struct
import threading
import time

import pytest

from seqlake.sources import live


def serve(scripts, opened):
    """One connection after another: answers the handshake, takes the subscription, sends the script's bytes, closes."""
    server = socket.create_server(("127.0.0.1", 0))

    def run():
        for script in scripts:
            conn, _ = server.accept()
            with conn, conn.makefile("rb") as f:
                head = dict(x.decode().strip().split(": ", 1) for x in itertools.takewhile(lambda x: x.strip(), iter(f.readline, b"")) if b": " in x)
                accept = base64.b64encode(hashlib.sha1((head["Sec-WebSocket-Key"] + live.SALT).encode()).digest()).decode()
                conn.sendall(f"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
                a, b = f.read(2)
                n = b & 127
                mask, data = f.read(4), f.read(n)
                opened.append(bytes(x ^ mask[i % 4] for i, x in enumerate(data)))
                conn.sendall(b"".join(script))
                if any(x[0] & 15 == live.PING for x in script):
                    opened.append(f.read(7)[0] & 15)
        server.close()

    threading.Thread(target=run, daemon=True).start()
    return f"ws://127.0.0.1:{server.getsockname()[1]}/feed?x=1"


def frame(data, code=live.TEXT, last=True):
    size = bytes([len(data)]) if len(data) < 126 else b"\x7e" + struct.pack(">H", len(data)) if len(data) < 65536 else b"\x7f" + struct.pack(">Q", len(data))
    return bytes([code | 0x80 * last]) + size + data


def test_frames_reseeds_and_waits():
    long, longer = b"x" * 300, b"y" * 70000
    opened, waits = [], []
    url = serve([[frame(b"one"), frame(b"tw", last=False), frame(b"o", live.MORE), frame(long)], [frame(longer), frame(b"\x03\xe8bye", live.CLOSE)], [frame(b"p", live.PING), frame(b"end")]], opened)
    got = list(itertools.islice(live.frames(lambda: live.WebSocket(url), b'{"subscribe":1}', sleep=waits.append, now_ns=lambda: 7), 8))
    assert [(k, d) for k, d, _, _ in got] == [("reseed", b""), ("message", b"one"), ("message", b"two"), ("message", long), ("reseed", b""), ("message", longer), ("reseed", b""), ("message", b"end")]
    assert got[0][3] == "subscribed" and "broke off" in got[4][3] and "closed: bye" in got[6][3]
    for _ in range(100):
        if len(opened) < 4:
            time.sleep(0.02)
    assert opened == [*[b'{"subscribe":1}'] * 3, live.PONG] and len(waits) == 2 and live.BASE / 2 <= waits[0] <= live.BASE <= waits[1] <= 2 * live.BASE


def test_waits_grow_until_a_connection_was_stable():
    clock, waits = itertools.count(0, 0.1), []

    def refuse():
        if len(waits) == 12:
            raise KeyboardInterrupt
        raise ConnectionRefusedError("no")

    with pytest.raises(KeyboardInterrupt):
        next(live.frames(refuse, b"", sleep=waits.append, clock=lambda: next(clock)))
    assert all(b <= live.MOST for b in waits) and waits[-1] >= live.MOST / 2 and waits[0] <= live.BASE
    steady, waits = itertools.count(0, 100), []
    with pytest.raises(KeyboardInterrupt):
        next(live.frames(refuse, b"", sleep=waits.append, clock=lambda: next(steady)))
    assert max(waits) <= live.BASE


def test_a_bad_answer_is_refused():
    with pytest.raises(ValueError):
        live.WebSocket("http://x")
    server = socket.create_server(("127.0.0.1", 0))

    def answer():
        conn, _ = server.accept()
        conn.recv(4096)
        conn.sendall(b"HTTP/1.1 403 Forbidden\r\n\r\n")
        conn.close()

    threading.Thread(target=answer, daemon=True).start()
    with pytest.raises(live.Closed):
        live.WebSocket(f"ws://127.0.0.1:{server.getsockname()[1]}")


def test_stream(spark, tmp_path):
    opened = []
    url = serve([[frame(b'{"n":%d}' % i) for i in range(5)], [frame(b'{"n":%d}' % i) for i in range(5, 8)], []], opened)
    spark.dataSource.register(live.LiveFeed)
    stream = spark.readStream.format("livefeed").options(url=url, subscription="{}", batch="100", gather_s="0.5").load()
    q = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            if spark.table("live").where("kind = 'message'").count() >= 8:
                break
            q.awaitTermination(1)
        rows = spark.table("live").orderBy("arrival").collect()
    finally:
        q.stop()
    assert [bytes(r.raw) for r in rows if r.kind == "message"] == [b'{"n":%d}' % i for i in range(8)]
    assert [r.epoch for r in rows if r.kind == "message"] == [1] * 5 + [2] * 3
