"""A live feed over a WebSocket: dial, subscribe, read; a reseed for every subscription; again and again with longer waits.

The client speaks RFC 6455 over a plain or TLS socket. What it hands over are frames as they came, with their local time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import queue
import socket
import ssl
import struct
import threading
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from seqlake.sources.store import backoff

#: Fixed values of the protocol: the key's salt, and the codes of frames.
SALT, MORE, TEXT, BINARY, CLOSE, PING, PONG = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11", 0, 1, 2, 8, 9, 10
#: Seconds: first and longest wait before a new connection, how long one must hold to count as stable, and how long a read may take.
BASE, MOST, STABLE, READ = 0.5, 30.0, 60.0, 30.0
MOST_MESSAGE = 32 << 20


class Closed(ConnectionError):
    """The other side ended the connection, or said what it may not."""


class WebSocket:
    def __init__(self, url: str, read_s: float = READ):
        at = urlsplit(url)
        if at.scheme not in ("ws", "wss") or not at.hostname:
            raise ValueError(f"{url!r} is no WebSocket address")
        plain = socket.create_connection((at.hostname, at.port or (443 if at.scheme == "wss" else 80)), timeout=read_s)
        self.socket = ssl.create_default_context().wrap_socket(plain, server_hostname=at.hostname) if at.scheme == "wss" else plain
        key = base64.b64encode(os.urandom(16)).decode()
        target = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.socket.sendall(f"GET {target} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        self.stream = self.socket.makefile("rb")
        status, *headers = iter(lambda: self.stream.readline(1 << 16).strip().decode("latin-1"), "")
        given = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in headers)}
        if " 101 " not in f"{status} " or given.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1((key + SALT).encode()).digest()).decode():
            self.close()
            raise Closed(f"no WebSocket: {status}")

    def send(self, data: bytes, code: int = TEXT) -> None:
        """One whole frame, masked as a client's must be."""
        n, mask = len(data), os.urandom(4)
        size = bytes([0x80 | n]) if n < 126 else b"\xfe" + struct.pack(">H", n) if n < 1 << 16 else b"\xff" + struct.pack(">Q", n)
        self.socket.sendall(bytes([0x80 | code]) + size + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))

    def _take(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) < n:
            raise Closed("the connection broke off")
        return data

    def messages(self) -> Iterator[bytes]:
        """Whole messages; pings are answered."""
        parts: list[bytes] = []
        while True:
            first, second = self._take(2)
            code, n = first & 15, second & 127
            if n > 125:
                (n,) = struct.unpack(">H" if n == 126 else ">Q", self._take(2 if n == 126 else 8))
            if second & 128 or n + sum(map(len, parts)) > MOST_MESSAGE:
                raise Closed(f"a frame of {n} bytes that may not be")
            data = self._take(n)
            if code == PING:
                self.send(data, PONG)
            elif code == CLOSE:
                raise Closed(f"closed: {data[2:].decode(errors='replace')}")
            elif code in (TEXT, BINARY, MORE):
                parts.append(data)
                if first & 128:
                    yield b"".join(parts)
                    parts = []

    def close(self) -> None:
        self.socket.close()


def frames(connect: Callable[[], WebSocket], subscription: bytes, *, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, now_ns: Callable[[], int] = time.time_ns) -> Iterator[tuple[str, bytes, int, str]]:
    """(kind, frame, local time, reason) for ever: after each subscription a reseed, then data until the connection ends.

    Waits grow while connections fail or end soon; one that was stable starts them anew.
    """
    attempt, why = 0, "subscribed"
    while True:
        began = clock()
        try:
            one = connect()
            try:
                one.send(subscription)
                yield "reseed", b"", now_ns(), why
                for data in one.messages():
                    yield "message", data, now_ns(), ""
            finally:
                one.close()
        except OSError as e:
            why = f"reconnect: {e}"
        attempt = 0 if clock() - began >= STABLE else attempt
        sleep(backoff(BASE, MOST, attempt))
        attempt += 1


class LiveReader(SimpleDataSourceStreamReader):
    """Frames gathered on the driver for at most ``gather_s`` seconds or ``batch`` frames a trigger.

    A thread reads into a queue of ``batch`` frames and waits when it is full, and so does the other side. A feed can't be
    asked again for what it said: a batch that is run again is read from what Spark kept of it.
    """

    def __init__(self, options: dict[str, str]):
        self.url, self.subscription = options["url"], options.get("subscription", "").encode()
        self.batch, self.gather_s = int(options.get("batch", 4096)), float(options.get("gather_s", 1))
        self.waiting: queue.Queue | None = None

    def initialOffset(self) -> dict:
        return {"at": 0, "epoch": 0}

    def _fill(self, into: queue.Queue) -> None:
        for one in frames(lambda: WebSocket(self.url), self.subscription):
            into.put(one)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.waiting is None:
            self.waiting = queue.Queue(self.batch)
            threading.Thread(target=self._fill, args=(self.waiting,), daemon=True).start()
        rows, at, epoch, until = [], start["at"], start["epoch"], time.monotonic() + self.gather_s
        while len(rows) < self.batch and (left := until - time.monotonic()) > 0:
            try:
                kind, raw, recv, reason = self.waiting.get(timeout=left)
            except queue.Empty:
                break
            epoch += kind == "reseed"
            rows.append((at, kind, raw, recv, epoch, reason or None))
            at += 1
        return iter(rows), {"at": at, "epoch": epoch}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        raise RuntimeError("a live feed can't be read again: its frames from " + str(start["at"]) + " on are lost, and the next subscription says so with a reseed")


class LiveFeed(DataSource):
    """``spark.readStream.format("livefeed").option("url", "wss://...").option("subscription", json).load()``."""

    @classmethod
    def name(cls) -> str:
        return "livefeed"

    def schema(self) -> str:
        return "arrival long, kind string, raw binary, recv_ns long, epoch long, reason string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LiveReader(dict(self.options))
