"""Checksums and codes of integers: CRC32C, zigzag, base 64."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Castagnoli polynomial, its bits reversed (fixed value).
POLYNOMIAL = 0x82F63B78


@functools.cache
def _tables() -> np.ndarray:
    """A checksum's change by each byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    return one


#: Bytes from which a text is worked on in lanes, and lanes at once.
WIDE, LANES = 1 << 14, 1 << 10


def _step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _tables()[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))


@functools.lru_cache(64)
def _past(n: int) -> tuple[list[list[int]], ...]:
    """What ``n`` zero bytes make of each byte of a checksum: four tables, as the change is linear in its bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image, square = bits.copy(), np.array([_step(np.array([b]), np.zeros(1, np.uint32))[0] for b in bits])

    def times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        chosen = (values[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(np.where(chosen == 1, matrix[None], np.uint32(0)), axis=1)

    while n:
        if n & 1:
            image = times(square, image)
        square, n = times(square, square), n >> 1
    return tuple(times(image, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).tolist() for k in range(4))


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli). Long data is cut into lanes that go on side by side, and whose checksums are put together after."""
    raw, crc = np.frombuffer(data, np.uint8), 0xFFFFFFFF
    if len(raw) >= WIDE:
        size = len(raw) // LANES
        lanes = raw[: size * LANES].reshape(LANES, size).T.astype(np.uint32)
        each = np.zeros(LANES, np.uint32)
        for column in lanes:
            each = _step(each, column)
        t0, t1, t2, t3 = _past(size)
        for own in each.tolist():
            crc = t0[crc & 255] ^ t1[crc >> 8 & 255] ^ t2[crc >> 16 & 255] ^ t3[crc >> 24] ^ own
        raw = raw[size * LANES :]
    one = _byte_table()
    for b in raw.tolist():
        crc = one[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@functools.cache
def _byte_table() -> list[int]:
    return _tables().tolist()


def crc32c_of(data: Column) -> Column:
    """CRC-32C of a binary column as a long; null for null."""

    @F.pandas_udf("long")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else crc32c(bytes(v)) for v in values], dtype="Int64")

    return each(data)


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..., as 64 bits."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(1)))


def base64_line(data: Column) -> Column:
    """Base 64 in one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")
