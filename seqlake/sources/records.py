"""Stored records and the row-oriented log: header, then type, length and payload of each."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from io import BufferedIOBase

#: Fixed values of the format.
MAGIC, VERSION, MESSAGE, GAP, RESEED, MOST = b"TAPE", 1, 1, 2, 3, 32 << 20
EXACT = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.([0-9]{1,18}))?", re.ASCII)


@dataclass(frozen=True)
class Record:
    """A message, gap or reseed with its local time."""

    kind: str
    recv_ns: int
    raw: bytes = b""
    expected: int = 0
    got: int = 0
    dropped: int = 0
    reason: str = ""

    def row(self) -> tuple:
        """(kind, recv_ns, raw, expected, got, dropped, reason), null where the kind has none."""
        if self.kind == "message":
            return self.kind, self.recv_ns, self.raw, None, None, None, None
        if self.kind == "gap":
            return self.kind, self.recv_ns, None, self.expected, self.got, self.dropped, None
        return self.kind, self.recv_ns, None, None, None, None, self.reason


def exact(text: str) -> tuple[int, int] | None:
    """(units, scale) of a decimal that its digits give back character for character."""
    found = EXACT.fullmatch(text)
    if not found:
        return None
    units = int(text.replace(".", ""))
    if text[0] == "-" and not units or not -(1 << 63) <= units < 1 << 63:
        return None
    return units, len(found[1] or "")


def header(version: int) -> bytes:
    return MAGIC + struct.pack("<HH", version, 0)


def read_version(f: BufferedIOBase) -> int:
    head = f.read(8)
    if len(head) < 8 or head[:4] != MAGIC:
        raise ValueError("no record log")
    return struct.unpack_from("<H", head, 4)[0]


def payload(r: Record) -> tuple[int, bytes]:
    if r.kind == "message":
        return MESSAGE, struct.pack("<q", r.recv_ns) + r.raw
    if r.kind == "gap":
        return GAP, struct.pack("<qQQ", r.recv_ns, r.expected, r.got) + (struct.pack("<Q", r.dropped) if r.dropped else b"")
    if r.kind == "reseed":
        return RESEED, struct.pack("<q", r.recv_ns) + r.reason.encode()
    raise ValueError(f"record kind {r.kind} is not known")


def from_payload(kind: int, body: bytes) -> Record:
    if len(body) < 8:
        raise ValueError("the payload is too short")
    (at,) = struct.unpack_from("<q", body)
    if kind == MESSAGE:
        return Record("message", at, raw=body[8:])
    if kind == GAP:
        if len(body) not in (24, 32):
            raise ValueError("a gap has 24 or 32 bytes")
        expected, got, *dropped = struct.unpack_from(f"<{len(body) // 8 - 1}Q", body, 8)
        return Record("gap", at, expected=expected, got=got, dropped=dropped[0] if dropped else 0)
    if kind == RESEED:
        return Record("reseed", at, reason=body[8:].decode(errors="replace"))
    raise ValueError(f"record type {kind} is not known")


def packed(r: Record) -> bytes:
    kind, body = payload(r)
    if len(body) > MOST:
        raise ValueError("the payload is too long")
    return struct.pack("<BI", kind, len(body)) + body


def read_rows(f: BufferedIOBase) -> Iterator[Record]:
    """The records after the header; a file that ends within one is an error."""
    while head := f.read(5):
        if len(head) < 5:
            raise ValueError("a record header is cut off")
        kind, size = struct.unpack("<BI", head)
        body = f.read(size) if size <= MOST else b""
        if len(body) < size:
            raise ValueError("a record is cut off")
        yield from_payload(kind, body)
