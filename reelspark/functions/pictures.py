"""Encoded pictures: PNG and BMP to plain bytes and back, and the set of pictures that a selection leaves on disk.

JPEG and WebP have no decoder here: JPEG files are handed on as they are, others count as
unreadable. A torn file, a wrong checksum or an unknown kind gives nulls, never an error.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the PNG format: signature, channels by colour type, and first column, first row, column step and row step of the interlaced passes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: The gray that transparent pixels are laid over (fixed value).
UNDERLAY = 240


class Unreadable(ValueError):
    """The bytes are no whole picture of a known kind."""


def kind(content: Column) -> Column:
    """png, bmp, jpeg, webp or other, by the first bytes; null content has no kind."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    webp = (head(1, 4) == "52494646") & (head(9, 4) == "57454250")
    known = F.when(head(1, 8) == SIGNATURE.hex().upper(), "png").when(head(1, 2) == "424D", "bmp").when(head(1, 3) == "FFD8FF", "jpeg").when(webp, "webp")
    return F.when(content.isNotNull(), known.otherwise("other"))


def unfiltered(rows: np.ndarray, unit: int) -> np.ndarray:
    """Scan lines without their filters; rows: the filter's number, then the bytes, `unit` of them a pixel.

    A pixel waits for its left, upper and upper left neighbours, so pixels whose column
    and row have the same sum are restored at once.
    """
    kinds, height, width = rows[:, 0], len(rows), (rows.shape[1] - 1) // unit
    if kinds.max(initial=0) > 4:
        raise Unreadable("unknown filter")
    body = rows[:, 1:].reshape(height, width, unit)
    if not kinds.any():
        return body.reshape(height, -1)
    out = np.zeros(((height + 1) * (width + 1), unit), np.uint8)  # a row above and a column before, of zeros
    inner = out.reshape(height + 1, width + 1, unit)[1:, 1:]
    inner[:] = body
    for d in range(width + height - 1):
        first, end = max(0, d - width + 1), min(height, d + 1)
        own = kinds[first:end, None]
        at = (first + 1) * (width + 1) + d - first + 1
        line = lambda back: out[at - back : at - back + (end - first - 1) * width + 1 : width]
        left, up, corner = (line(back).astype(np.int16) for back in (1, width + 1, width + 2))
        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.select([own == 1, own == 2, own == 3, own == 4], [left, up, (left + up) >> 1, nearest], np.int16(0))
        line(0)[:] += guess.astype(np.uint8)
    return np.ascontiguousarray(inner).reshape(height, -1)


def _samples(data: np.ndarray, width: int, height: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """height x width x channels numbers from filtered scan lines, and the bytes used."""
    stride = (width * channels * depth + 7) // 8
    used = height * (stride + 1)
    rows = unfiltered(data[:used].reshape(height, stride + 1), max(1, channels * depth // 8))
    if depth == 16:
        own = rows.view(">u2").astype(np.uint16)
    elif depth == 8:
        own = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        own = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, :width]
    return own.reshape(height, width, channels), used


def _chunks(raw: bytes):
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(raw):
            raise Unreadable("torn")
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(raw) < at + 12 + size or struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(name)):
            raise Unreadable("torn or changed")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size


def png_pixels(raw: bytes) -> np.ndarray:
    """height x width x channels of a PNG, 8 or 16 bits; colours of a palette are looked up, and what is marked transparent gets an alpha channel."""
    head, palette, clear, data = None, None, None, []
    for name, body in _chunks(raw):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            data.append(body)
    width, height, depth, colour, _, _, laced = head
    if not width or not height or depth not in DEPTHS.get(colour, ()) or laced > 1:
        raise Unreadable("odd header")
    channels, packed = CHANNELS[colour], b"".join(data)
    parts = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if laced else ((0, 0, 1, 1),)) if x < width and y < height]
    size = sum(h * ((w * channels * depth + 7) // 8 + 1) for *_, w, h in parts)
    if size > 1040 * len(packed) + 1040:  # more than bytes can hold once inflated: memory is asked for only by what is there
        raise Unreadable("torn")
    flat = np.frombuffer(zlib.decompressobj().decompress(packed, size), np.uint8)
    if len(flat) < size:
        raise Unreadable("torn")
    own, at = np.empty((height, width, channels), np.uint16 if depth == 16 else np.uint8), 0
    for x, y, dx, dy, w, h in parts:
        own[y::dy, x::dx], used = _samples(flat[at:], w, h, channels, depth)
        at += used
    if colour == 3:
        if palette is None or own.max() >= len(palette):
            raise Unreadable("colour outside the palette")
        if clear is None:
            return palette[own[..., 0]]
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return np.dstack([palette[own[..., 0]], alpha[own[..., 0]]])
    top = 65535 if depth == 16 else 255
    seen = own if clear is None or colour in (4, 6) else np.dstack([own, np.where((own == np.frombuffer(clear, ">u2")).all(axis=2), 0, top).astype(own.dtype)])
    if depth < 8:
        seen[..., 0] *= 255 // (2**depth - 1)
    return seen


def bmp_pixels(raw: bytes) -> np.ndarray:
    """height x width x 3 of an uncompressed BMP of 8, 24 or 32 bits a pixel, or 4 channels where its masks name an alpha in whole bytes."""
    start, size, width, height, _, depth, packing = struct.unpack_from("<10xIIiiHHI", raw)
    if size < 40 or width <= 0 or not height or depth not in (8, 24, 32) or packing not in ((0, 3) if depth == 32 else (0,)):
        raise Unreadable("odd header")
    stride = (width * depth + 31) // 32 * 4
    if len(raw) < start + stride * abs(height):
        raise Unreadable("torn")
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:: -1 if height > 0 else 1]
    if depth == 8:
        colours = struct.unpack_from("<I", raw, 46)[0] or 256
        table = np.frombuffer(raw, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        if rows[:, :width].max() >= colours:
            raise Unreadable("colour outside the palette")
        return table[rows[:, :width]]
    own = rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    if packing == 0:
        return own[..., 2::-1]
    masks = struct.unpack_from("<IIII" if size >= 56 else "<III", raw, 54)
    places = [(255 << s, k) for k, s in enumerate((0, 8, 16, 24))]
    order = [next((k for m, k in places if m == mask), None) for mask in masks if mask]
    if None in order or len(order) < 3:
        raise Unreadable("odd masks")
    return own[..., order]


def pixels(raw: bytes | None) -> np.ndarray | None:
    """height x width x channels (1 to 4) of 8 or 16 bits, or None for what is no whole picture."""
    try:
        return png_pixels(raw) if raw.startswith(SIGNATURE) else bmp_pixels(raw) if raw.startswith(b"BM") else None
    except (ValueError, struct.error, zlib.error, TypeError, AttributeError):
        return None


def flattened(own: np.ndarray) -> np.ndarray:
    """Three channels of 8 bits: 16 bits are divided by 257, gray is repeated, transparent pixels lie over light gray; fractions are cut off."""
    own = (own.astype(np.float32) / np.float32(257)).astype(np.uint8) if own.dtype == np.uint16 else own
    if own.shape[2] in (2, 4):
        alpha = own[..., -1:].astype(np.float32) / np.float32(255)
        own = (alpha * own[..., :-1] + (1 - alpha) * np.float32(UNDERLAY)).clip(0, 255).astype(np.uint8)
    return np.repeat(own, 3, axis=2) if own.shape[2] == 1 else own


def png(own: np.ndarray) -> bytes:
    """A PNG of height x width x channels (1 to 4; 8 or 16 bits), each line as its difference from the one above."""
    height, width, channels = own.shape
    depth = 8 * own.dtype.itemsize
    lines = np.ascontiguousarray(own, ">u2" if depth == 16 else np.uint8).view(np.uint8).reshape(height, -1)
    rows = np.full((height, lines.shape[1] + 1), 2, np.uint8)
    rows[:, 1:] = lines
    rows[1:, 1:] -= lines[:-1]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))
    head = struct.pack(">IIBBBBB", width, height, depth, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _kinds(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def decoded(pictures: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """keep, w, h, channels and bits as stored, and pixels (rgb, a byte each, see flattened); nulls for what cannot be read.

    A task holds one Arrow batch of encoded files and the plain bytes of one picture at a time beside what it hands on.
    """

    def look(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = pixels(batch.column(batch.num_columns - 1)[k].as_py())
                made = (None,) * 5 if own is None else (own.shape[1], own.shape[0], own.shape[2], 8 * own.dtype.itemsize, flattened(own).tobytes())
                found = [pa.array([v], t) for v, t in zip(made, [*[pa.int32()] * 4, pa.binary()])]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:-1]), *found], [*keep, "w", "h", "channels", "bits", "pixels"])

    given = pictures.select(*keep, content)
    return given.mapInArrow(look, f"{_kinds(given, keep)}w int, h int, channels int, bits int, pixels binary")


def encoded(pictures: DataFrame, keep: list[str], channels: int = 3) -> DataFrame:
    """keep and content, a PNG of raw pictures (pixels, w, h; `channels` bytes a pixel); null where bytes are missing."""

    def make(batches):
        for batch in batches:
            made = []
            for raw, w, h in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                whole = raw and w and h and w > 0 and h > 0 and len(raw) >= w * h * channels
                made.append(png(np.frombuffer(raw, np.uint8, w * h * channels).reshape(h, w, channels)) if whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(made, pa.binary())], [*keep, "content"])

    given = pictures.select(*keep, "pixels", "w", "h")
    return given.mapInArrow(make, f"{_kinds(given, keep)}content binary")


def numbered_set(selected: DataFrame, key: str, order: list[str], content: str = "content") -> DataFrame:
    """The files of a selection: key, rank, name and content, one row for each selected row; what cannot be read has a null rank, name and content.

    JPEG files stay as they are; PNG and BMP become three channels of 8 bits, as PNG, since
    no JPEG encoder is at hand. Ranks run over the readable ones without gaps. `key` is
    unique and `order` total; ranks are counted over slim rows in one task, as many as the
    selection's quotas allow; the files themselves stay in their tasks.
    """
    from ..operators.lineage import cut

    def make(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw, jpeg = (batch.column(batch.num_columns - n)[k].as_py() for n in (2, 1))
                if not jpeg:
                    own = pixels(raw)
                    raw = None if own is None else png(flattened(own))
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:-2]), pa.array([raw], pa.binary()), pa.array([jpeg])], [key, *order, "made", "jpeg"])

    given = selected.select(key, *order, F.col(content), F.coalesce(kind(F.col(content)) == "jpeg", F.lit(False)).alias("jpeg"))
    files = cut(given.mapInArrow(make, f"{_kinds(given, [key, *order])}made binary, jpeg boolean"))
    ranks = files.where("made IS NOT NULL").select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))
    name = F.format_string("%04d.%s", "rank", F.when(F.col("jpeg"), "jpg").otherwise("png"))
    return files.join(ranks, key, "left").select(key, "rank", F.when(F.col("rank").isNotNull(), name).alias("name"), F.col("made").alias("content"))
