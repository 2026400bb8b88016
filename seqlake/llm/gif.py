"""GIF images in columns: an encoder for 8-bit samples, and a decoder of whole animations.

The decoder reads the LZW code streams, interlaced or not, applies local or global palettes, transparency and the disposal of
each frame, and gives the timed frames as they are shown, each with a colour histogram.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import column, cut, drop, map_rows

WIDTH, HEIGHT, BLOCK = 24, 24, 576
#: Blocks of 24 x 24 samples that stand above one another in a frame, and a frame's time in hundredths of a second.
BLOCKS_PER_FRAME, DELAY = 16, 10
#: Fixed values of the format: the longest code has 12 bits, a sub-block up to 255 bytes.
MOST_CODES, SUB_BLOCK = 4096, 255
#: Levels of each of red, green and blue in a histogram: 4 ** 3 bins.
LEVELS = 4


@cache
def widths(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, and the bits of all before it."""
    clear = 1 << min_size
    known = np.minimum(clear + 2 + np.maximum(np.arange(2 * MOST_CODES) - 1, 0), MOST_CODES)
    bits = np.full(len(known), min_size + 1)
    for w in range(min_size + 1, 12):
        bits[known + 1 > 1 << w] = w + 1
    return bits, np.concatenate([[0], np.cumsum(bits)])


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """The code stream of ``samples``: a clear code first and whenever the table is full, the end code last."""
    clear, top = 1 << min_size, MOST_CODES - 1
    codes, starts, table, free = [clear], [1], {}, clear + 2
    get, put = table.get, codes.append
    if samples:
        w = samples[0]
        for b in memoryview(samples)[1:]:
            c = get(k := w << 8 | b)
            if c is not None:
                w = c
                continue
            put(w)
            if free < top:
                table[k] = free
                free += 1
            else:
                put(clear)
                starts.append(len(codes))
                table.clear()
                free = clear + 2
            w = b
        put(w)
    put(clear + 1)
    all_codes, of = np.array(codes, np.uint64), widths(min_size)[0]
    size = np.full(len(codes), min_size + 1, np.int64)
    for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
        size[a:b] = of[: b - a]  # a clear code that ends a run has the width that its place has
    return pack(all_codes, size)


def pack(codes: np.ndarray, size: np.ndarray) -> bytes:
    """Codes of ``size`` bits, least significant bit first."""
    at = np.cumsum(size) - size
    shifted = codes << (at & 7).astype(np.uint64)  # 12 + 7 bits at most: three bytes
    first, length = at >> 3, int(at[-1] + size[-1] + 7 >> 3)
    out = np.zeros(length + 3)
    for k in range(3):  # codes share no bit, so their sum in a byte is their union
        out[k:] += np.bincount(first, (shifted >> np.uint64(8 * k) & np.uint64(255)).astype(np.float64), minlength=length + 3 - k)
    return out[:length].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, min_size: int, most: int) -> bytes:
    """Up to ``most`` samples of a code stream; what a stream lacks is left out."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    bits, before = widths(min_size)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    total, at, out, got = len(data) * 8, 0, [], 0
    table, prev, k = list(roots), b"", 0  # k: codes read since the last clear code
    while at + min_size < total and got < most:
        base = int(before[k])
        n = int(np.searchsorted(before, base + total - at, side="right")) - 1 - k
        n = min(n, len(bits) - k, 512 if not k else MOST_CODES)
        if n <= 0:
            break
        where = at + before[k : k + n] - base
        byte = where >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (where & 7).astype(np.uint32)) & ((1 << bits[k : k + n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        for code in codes[:stop].tolist():
            known = len(table)
            if code < known:
                s = table[code]
                if prev and known < MOST_CODES:
                    table.append(prev + s[:1])
            else:
                if code > known or not prev:
                    raise ValueError(f"code {code} has no entry")
                s = prev + prev[:1]
                if known < MOST_CODES:
                    table.append(s)
            out.append(s)
            got += len(s)
            prev = s
        if stop < n:
            at += int(before[k + stop + 1]) - base
            if codes[stop] == end:
                break
            table, prev, k = list(roots), b"", 0
        else:
            at += int(before[k + n]) - base
            k = min(k + n, MOST_CODES)  # the width stays at 12 bits from there on
    return b"".join(out)[:most]


@dataclass
class Frame:
    """A frame as shown: ``rgb`` and ``shown`` (False: transparent) are the whole canvas; the rectangle is what it drew."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    rgb: np.ndarray
    shown: np.ndarray

    def drawn(self) -> np.ndarray:
        return self.rgb[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> np.ndarray:
        """Visible pixels of the canvas in each of 64 colour bins."""
        q = self.rgb[self.shown].astype(np.int32) * LEVELS >> 8
        return np.bincount((q[:, 0] * LEVELS + q[:, 1]) * LEVELS + q[:, 2], minlength=LEVELS**3)


GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode_gif(payload: bytes) -> bytes:
    """An animation whose grey samples are ``payload``, a positive multiple of 576 bytes, 24 samples a row."""
    blocks = len(payload) // BLOCK
    if not blocks or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    high = min(blocks, BLOCKS_PER_FRAME) * HEIGHT
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, high, 0xF7, 0, 0), GREY]
    for i in range(0, blocks, BLOCKS_PER_FRAME):
        part = payload[i * BLOCK : (i + BLOCKS_PER_FRAME) * BLOCK]
        codes = lzw_encode(part)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        for k in range(0, len(codes), SUB_BLOCK):
            out += [bytes([len(codes[k : k + SUB_BLOCK])]), codes[k : k + SUB_BLOCK]]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + 3 * n


def _rows(pixels: np.ndarray, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return pixels
    h = len(pixels)
    order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(pixels)
    out[order] = pixels
    return out


def decode_gif(data: bytes) -> list[Frame]:
    """The frames of a GIF as shown; raises ValueError where the bytes are no GIF or a code has no entry."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _palette(data, 13, flags)
    rgb, shown = np.zeros((high, wide, 3), np.uint8), np.zeros((high, wide), bool)
    frames: list[Frame] = []
    delay, disposal, clear_index = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = control >> 2 & 7, index if control & 1 else -1
        elif kind == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, local)
            palette = own if own is not None else shared
            if palette is None:
                raise ValueError("a frame has no palette")
            min_size = data[at]
            codes, at = _sub_blocks(data, at + 1)
            samples = lzw_decode(codes, min_size, w * h).ljust(w * h, b"\0")
            index = _rows(np.frombuffer(samples, np.uint8).reshape(h, w), bool(local & 0x40))
            before = (rgb.copy(), shown.copy()) if disposal == 3 else None
            h, w = max(0, min(h, high - top)), max(0, min(w, wide - left))  # what lies outside the canvas is not shown
            index, box = index[:h, :w], (slice(top, top + h), slice(left, left + w))
            colours = np.zeros((256, 3), np.uint8)
            colours[: len(palette)] = palette
            if clear_index < 0:
                rgb[box], shown[box] = colours[index], True
            else:
                paint = index != clear_index
                rgb[box][paint] = colours[index[paint]]
                shown[box] |= paint
            frames.append(Frame(left, top, w, h, delay * 10, disposal, rgb.copy(), shown.copy()))
            if disposal == 2:
                rgb[box], shown[box] = 0, False
            elif before:
                rgb, shown = before
            delay, disposal, clear_index = 0, 0, -1
        else:
            raise ValueError(f"block {kind:#x} at {at} is not known")
    return frames


def text_payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: each whole text's bytes, filled up with 255 to whole blocks, as an animated grey GIF.

    Null and empty texts become one block of 255. Equal texts give equal media; repeated rows repeat; an empty table gives
    none; further columns are not read.
    """

    def per_batch(batch: pa.RecordBatch) -> dict:
        data = column(batch, text).to_pylist()
        return {id_col: column(batch, id_col), "n_bytes": [len((x or "").encode()) for x in data], "media": [encode_gif(text_payload(x)) for x in data]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text), per_batch, f"`{id_col}` {kind}, n_bytes long, media binary")


#: A frame as shown: the whole canvas, row by row, with one channel if it is grey and three else; ``shown`` has a byte for each
#: pixel, 0 where it is transparent, and is null where none is. The rectangle is what the frame drew.
FRAMES = "array<struct<left:int,top:int,width:int,height:int,delay_ms:int,disposal:int,canvas_width:int,canvas_height:int,channels:int,pixels:binary,shown:binary,colour_sums:array<bigint>,histogram:array<int>>>"
PAYLOAD = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"


def frame_columns(f: Frame, pixels: bool) -> dict:
    r, g, b = (f.rgb[..., i] for i in range(3))
    grey, whole = bool((r == g).all() and (g == b).all()), bool(f.shown.all())
    if grey:
        counts = np.bincount(r.ravel() if whole else r[f.shown], minlength=256)
        sums = [int(counts @ np.arange(256))] * 3
        histogram = np.zeros(LEVELS**3, np.int64)
        histogram[np.arange(LEVELS) * (LEVELS * LEVELS + LEVELS + 1)] = counts.reshape(LEVELS, -1).sum(1)
    else:
        sums, histogram = f.rgb[f.shown].sum(0, dtype=np.int64).tolist(), f.histogram()
    return {k: getattr(f, k) for k in ("left", "top", "width", "height", "delay_ms", "disposal")} | {
        "canvas_width": f.rgb.shape[1], "canvas_height": f.rgb.shape[0], "channels": 1 if grey else 3, "pixels": (r if grey else f.rgb).tobytes() if pixels else None,
        "shown": None if whole else f.shown.tobytes(), "colour_sums": sums, "histogram": histogram.tolist(),
    }


def read_frames(media: DataFrame, *, id_col: str = "doc_id", column_name: str = "media", keep: list[str] | None = None, pixels: bool = True, payload: bool = False) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``frames``: the timed frames of each GIF as shown, each with its colour sums and histogram.

    ``pixels``: whether the canvas stands in the frames, too (it can be had from the media again). ``payload``: whether
    ``payload_bytes, payload_sha256, tail_crc32`` of the grey samples that the frames drew are wanted. Null or broken media
    have nulls. Repeated rows repeat; an empty table gives none.
    """
    names = [id_col, *(keep or [])]

    def one(data: bytes | None) -> tuple:
        try:
            found = decode_gif(data) if data else None
        except (ValueError, IndexError, struct.error):
            found = None
        if found is None:
            return None, None, None, None
        drawn = read_payload(found) if payload else b""
        return [frame_columns(f, pixels) for f in found], len(drawn), hashlib.sha256(drawn).hexdigest(), zlib.crc32(drawn[-32:])

    def per_batch(batch: pa.RecordBatch) -> dict:
        read = [one(x) for x in column(batch, column_name).to_pylist()]
        return {c: column(batch, c) for c in names} | {n: [r[i] for r in read] for i, n in enumerate(("frames", "payload_bytes", "payload_sha256", "tail_crc32"))}

    own = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)
    return map_rows(media.select(*names, column_name), per_batch, f"{own}, frames {FRAMES}{', ' + PAYLOAD if payload else ''}")


def read_payload(frames: list[Frame]) -> bytes:
    """The grey samples that the frames drew."""
    return b"".join(f.drawn()[:, :, 0].tobytes() for f in frames)


#: Number of frames, their time, the mean of each channel, and the share of each bin of the colour histogram that has any (per mille).
FEATURE = """concat('frames=', n, ';ms=', ms, ';mean=', array_join(transform(sums, x -> format_string('%.3f', x / total)), ','),
 ';bins=', array_join(transform(filter(sequence(0, size(bins) - 1), i -> bins[i] > 0), i -> concat(i, ':', bins[i] * 1000 div total)), ','))"""


def digest_media(stored: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` of stored columns, in SQL.

    ``stored`` has the payload's and media's figures and ``frames``, whose colour sums and histograms make the feature.
    """
    added = lambda field, zero: f"aggregate(frames, {zero}, (a, f) -> zip_with(a, f.{field}, (x, y) -> x + y))"
    rows = stored.withColumns({
        "n": F.size("frames"), "ms": F.expr("aggregate(frames, 0, (a, f) -> a + f.delay_ms)"),
        "sums": F.expr(added("colour_sums", "array(0L, 0L, 0L)")), "bins": F.expr(added("histogram", f"array_repeat(0L, {LEVELS**3})")),
    }).withColumn("total", F.expr("greatest(aggregate(bins, 0L, (a, x) -> a + x), 1L)"))
    return rows.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.expr(FEATURE).alias("feature"))


def store_and_digest(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest_media`` of texts whose GIFs, and then the timed frames read from them with their histograms, are written as tables.

    The frames are stored without their pixels, which the GIFs have.
    """
    media = cut(store_texts(docs, id_col=id_col, text=text), "media", compression="zstd")
    summed = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    frames = cut(read_frames(summed, id_col=id_col, keep=["n_bytes", "media_bytes", "media_sha256"], pixels=False, payload=True), "frames", compression="zstd")
    drop(media)
    return digest_media(frames, id_col=id_col)
