"""Where files are kept: any file system that pyarrow knows by its address, and puts that never overwrite."""

from __future__ import annotations

import os
import random
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from io import BufferedIOBase

from pyarrow import fs

#: Fixed value: what window files are called.
SUFFIX = ".tape"


class Taken(FileExistsError):
    """The key has an object already; stored data is never rewritten."""


def valid_symbol(symbol: str) -> str:
    """A symbol that can stand in a key: not empty, without ``/`` and ``=``."""
    if not symbol or "/" in symbol or "=" in symbol:
        raise ValueError(f"{symbol!r} is no symbol")
    return symbol


class Store:
    """Objects below ``root`` (a path or an address such as ``hdfs://`` or ``s3://``), by key."""

    def __init__(self, root: str, filesystem: fs.FileSystem | None = None):
        self.root = root
        if filesystem is not None:
            self.fs, self.base = filesystem, root
        elif "://" in root:
            self.fs, self.base = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
        else:
            self.fs, self.base = fs.LocalFileSystem(), os.path.abspath(root)
        self.base = self.base.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.base}/{key}" if key else self.base

    def list(self, prefix: str = "") -> list[str]:
        """Keys that begin with ``prefix``, by their bytes; a folder that is missing has none."""
        folder = prefix.rpartition("/")[0]
        found = self.fs.get_file_info(fs.FileSelector(self.path(folder), recursive=True, allow_not_found=True))
        keys = [x.path[len(self.base) + 1 :] for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        return sorted((k for k in keys if k.startswith(prefix)), key=str.encode)

    def is_file(self, key: str = "") -> bool:
        return self.fs.get_file_info(self.path(key)).type == fs.FileType.File

    def size(self, key: str) -> int:
        return self.fs.get_file_info(self.path(key)).size

    def open(self, key: str) -> BufferedIOBase:
        return self.fs.open_input_file(self.path(key))

    def stage(self, data: bytes) -> str:
        """Write ``data`` beside the objects; no listing shows it until it is put in place."""
        key = f"_staged/{uuid.uuid4().hex}"
        self.fs.create_dir(self.path("_staged"), recursive=True)
        with self.fs.open_output_stream(self.path(key)) as f:
            f.write(data)
        return key

    def place(self, staged: str, key: str) -> None:
        """Give a staged object its key; ``Taken`` if the key has one.

        On a local disk this is one step of the system. Elsewhere the key is looked up first, so one writer must own each key.
        """
        self.fs.create_dir(self.path(key).rpartition("/")[0], recursive=True)
        if isinstance(self.fs, fs.LocalFileSystem):
            try:
                os.link(self.path(staged), self.path(key))
            except FileExistsError:
                raise Taken(key) from None
            finally:
                self.drop(staged)
            return
        if self.fs.get_file_info(self.path(key)).type != fs.FileType.NotFound:
            self.drop(staged)
            raise Taken(key)
        self.fs.move(self.path(staged), self.path(key))

    def put(self, key: str, data: bytes) -> None:
        self.place(self.stage(data), key)

    def drop(self, staged: str) -> None:
        if self.is_file(staged):
            self.fs.delete_file(self.path(staged))


def window_keys(store: Store, **parts: str) -> list[str]:
    """The window files below a store's root, by their bytes, of the given ``symbol``, ``date`` and ``hour``; none is an error."""
    wanted = {f"{k}={v}" for k, v in parts.items() if v}
    found = [k for k in store.list() if k.endswith(SUFFIX) and wanted <= set(k.split("/")[:-1])]
    if not found:
        raise FileNotFoundError(f"{store.root} holds no {SUFFIX} file{' of ' + ', '.join(sorted(wanted)) if wanted else ''}")
    return found


def backoff(base: float, most: float, attempt: int, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait before attempt ``attempt`` (from 0): twice as long each time, drawn from the upper half of the wait."""
    half = min(base * 2.0 ** min(attempt, 64), most) / 2
    return half + jitter() * half


@dataclass
class Uploader:
    """Copies closed files to a store, from a queue that never blocks who fills it. A key that is taken counts as stored.

    A file that fails every attempt, or finds the queue full, is left where it is and counted.
    """

    store: Store
    queue: int = 64
    attempts: int = 6
    base: float = 0.5
    most: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    waiting: deque[tuple[str, str]] = field(default_factory=deque)
    events: list[dict] = field(default_factory=list)
    thread: threading.Thread | None = None
    closing: bool = False

    def start(self) -> None:
        """Upload beside whoever adds files, until ``close``."""

        def work() -> None:
            while not self.closing:
                self.drain(float("inf")) if self.waiting else time.sleep(0.02)

        self.thread = threading.Thread(target=work, daemon=True)
        self.thread.start()

    def close(self, seconds: float = 30.0) -> None:
        """End the thread, if there is one, and upload what still waits for at most ``seconds``."""
        self.closing = True
        if self.thread:
            self.thread.join(seconds)
        self.drain(seconds)

    def add(self, path: str, key: str) -> bool:
        if len(self.waiting) >= self.queue:
            self.events.append({"key": key, "outcome": "dropped", "attempts": 0, "bytes": 0})
            return False
        self.waiting.append((path, key))
        return True

    def drain(self, seconds: float = 30.0) -> None:
        """Upload what waits; what is not stored after ``seconds`` has failed."""
        until = time.monotonic() + seconds
        while self.waiting:
            path, key = self.waiting.popleft()
            outcome, size, attempt = "failed", 0, 0
            while attempt < self.attempts and (not attempt or time.monotonic() < until):
                attempt += 1
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                    self.store.put(key, data)
                    outcome, size = "uploaded", len(data)
                    break
                except Taken:
                    outcome = "existed"
                    break
                except OSError:
                    if attempt < self.attempts:
                        self.sleep(max(min(backoff(self.base, self.most, attempt - 1), until - time.monotonic()), 0))
            self.events.append({"key": key, "outcome": outcome, "attempts": attempt, "bytes": size})
