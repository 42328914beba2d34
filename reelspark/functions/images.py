"""Measures of gray pictures: native expressions on pixel arrays, and one Arrow kernel on bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import clamp
from .vectors import bound

SIDE = 32  # of the picture a hash is made from


def exposure(pixels: Column) -> Column:
    """Share of middle tones less half the share of the darkest and brightest eighths of a 64-step scale."""
    share = lambda low, high: F.size(F.filter(pixels, lambda p: (p >= low) & (p < high))) / F.size(pixels)
    return F.when(F.size(pixels) > 0, clamp(share(16, 240) - 0.5 * (share(0, 8) + share(248, 256)), 0.0, 1.0)).otherwise(0.0)


def laplacian_variance(gray: np.ndarray) -> float:
    g = np.pad(gray.astype(np.float64), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(np.float64), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)
    basis = np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def block_mean(gray: np.ndarray, side: int = SIDE, width: int | None = None) -> np.ndarray:
    """The picture shrunk or stretched to side x side, or to a height and a width, by area averages."""

    def weights(n: int, side: int) -> np.ndarray:
        edges = np.arange(side + 1) * n / side
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
        return np.clip(high - low, 0, None) * side / n

    return weights(gray.shape[0], side) @ gray.astype(np.float64) @ weights(gray.shape[1], width or side).T


def sharpness(gray: np.ndarray, most: int = 256) -> float:
    """Edge energy of the picture with its longest side at most `most`, brought to 0..1."""
    longest = max(gray.shape)
    if longest > most:
        height, width = (max(1, round(n * most / longest)) for n in gray.shape)
        gray = np.rint(block_mean(gray, height, width))
    return float(np.tanh(np.log1p(laplacian_variance(gray) / (float(gray.mean()) ** 2 + 1e-6))))


def perceptual_hash(gray: np.ndarray, clear_first: bool = True) -> int:
    """64 bits, which low frequencies exceed their median, as a signed number."""
    basis = cosine_basis(SIDE)[:8]
    low = basis @ block_mean(gray) @ basis.T
    if clear_first:
        low[0, 0] = 0.0
    return int(np.packbits((low > np.median(low)).ravel(), bitorder="little").view("<i8")[0])


def content_box(gray: np.ndarray, dark: float = 10.0) -> tuple[int, int, int, int]:
    """left, top, right, bottom without dark borders, each searched up to a limit; never empty."""
    most = max(64, min(gray.shape) // 8)

    def edges(means: np.ndarray) -> tuple[int, int]:
        n, bright = len(means), np.flatnonzero(means > dark)
        low, high = (int(bright[0]), int(bright[-1]) + 1) if len(bright) else (n, 0)
        low, high = min(low, most, n), max(high, n - most, 0)
        low = max(0, min(high - 1, low))
        return low, max(low + 1, min(n, high))

    (left, right), (top, bottom) = edges(gray.mean(axis=0)), edges(gray.mean(axis=1))
    return left, top, right, bottom


def measure(pictures: DataFrame, keep: list[str], pixels: str = "pixels", width: str = "w", height: str = "h") -> DataFrame:
    """keep, sharpness, phash and the content box of gray pictures given as one byte a pixel. A null or short picture gets nulls."""

    def look(batches):
        for batch in batches:
            found = []
            for raw, w, h in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                if not raw or not w or not h or len(raw) < w * h:
                    found.append((None,) * 6)
                    continue
                gray = np.frombuffer(raw, np.uint8, w * h).reshape(h, w)
                found.append((sharpness(gray), perceptual_hash(gray), *content_box(gray)))
            made = [pa.array(c, t) for c, t in zip(zip(*found), [pa.float64(), pa.int64(), *[pa.int32()] * 4])] if found else [pa.array([], t) for t in [pa.float64(), pa.int64(), *[pa.int32()] * 4]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], [*keep, "sharpness", "phash", "left", "top", "right", "bottom"])

    given = pictures.select(*keep, pixels, width, height)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-3])
    return given.mapInArrow(look, f"{kinds}, sharpness double, phash long, left int, top int, right int, bottom int")


def edge_energy(pixels: Column, side: int) -> Column:
    """Variance of the Laplacian over the squared mean of a square gray picture given as an array; borders are mirrored."""
    last = side - 1
    mirrored = lambda i: -i if i < 0 else 2 * last - i if i > last else i
    mean = lambda v, of=lambda x: x: F.aggregate(v, F.lit(0.0), lambda s, x: s + of(x)) / F.size(v)

    def places(right: int, down: int) -> Column:
        """Where each pixel's neighbour stands in the array, as a constant that Spark computes once and not for each pixel."""
        found = [mirrored(y + down) * side + mirrored(x + right) for y in range(side) for x in range(side)]
        return F.split(F.lit(" ".join(map(str, found))), " ").cast("array<int>")

    def bends(own: Column) -> Column:
        at = lambda i: F.get(own, i)
        around = F.zip_with(places(-1, 0), places(1, 0), lambda i, j: at(i) + at(j))
        for vertical in (places(0, -1), places(0, 1)):
            around = F.zip_with(around, vertical, lambda s, i: s + at(i))
        return F.struct(F.transform(around, lambda s, i: s - 4 * at(i)).alias("b"), mean(own).alias("g"))

    def energy(t: Column) -> Column:
        square = mean(t["b"], lambda x: x * x)
        return bound(mean(t["b"]), lambda m: (square - m * m) / (t["g"] * t["g"] + 1e-6))

    return bound(bound(pixels, bends), energy)


def cut_out(pictures: DataFrame, keep: list[str], channels: int = 3) -> DataFrame:
    """keep, w, h and pixels of the part of each raw picture (pixels, w, h; `channels` bytes a pixel) inside its box x1, y1, x2, y2.

    The box is cut at the picture's edge; what is left empty, or a picture with too few bytes, gives null pixels.
    """

    def look(batches):
        for batch in batches:
            made = []
            for raw, w, h, *box in zip(*(c.to_pylist() for c in batch.columns[-7:])):
                x1, y1, x2, y2 = (0 if b is None else max(0, min(int(b), m or 0)) for b, m in zip(box, (w, h, w, h)))
                if not raw or len(raw) < w * h * channels or x2 <= x1 or y2 <= y1:
                    made.append((None, None, None))
                else:
                    part = np.frombuffer(raw, np.uint8, w * h * channels).reshape(h, w, channels)[y1:y2, x1:x2]
                    made.append((x2 - x1, y2 - y1, part.tobytes()))
            own = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-7], *own], [*keep, "w", "h", "pixels"])

    given = pictures.select(*keep, "pixels", "w", "h", "x1", "y1", "x2", "y2")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-7])
    return given.mapInArrow(look, f"{kinds}, w int, h int, pixels binary")


def model_input(pixels: Column, side: int = 112) -> Column:
    """Numbers of -1 to 1, channel by channel, from a chip of side x side pixels given as an array of interleaved bytes."""
    at = lambda i: F.get(pixels, (F.pmod(i, F.lit(side * side)) * 3 + F.floor(i / (side * side))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(3 * side * side - 1)), lambda i: (at(i) / 127.5 - 1.0).cast("float"))


def outlined(pictures: DataFrame, keep: list[str], colour: tuple[int, ...] = (0, 255, 0), thick: int = 2) -> DataFrame:
    """keep, w, h and pixels of raw pictures (pixels, w, h; a byte a channel) with the outlines of their boxes, an array of structs x1, y1, x2, y2, drawn in."""

    def look(batches):
        for batch in batches:
            made = []
            for raw, w, h, boxes in zip(*(c.to_pylist() for c in batch.columns[-4:])):
                if not raw or len(raw) < w * h * len(colour):
                    made.append(raw)
                    continue
                own = np.frombuffer(raw, np.uint8, w * h * len(colour)).reshape(h, w, len(colour)).copy()
                for b in boxes or ():
                    x1, x2 = (max(0, min(w, int(b[k]))) for k in ("x1", "x2"))
                    y1, y2 = (max(0, min(h, int(b[k]))) for k in ("y1", "y2"))
                    for part in (own[y1:y2, x1 : min(x2, x1 + thick)], own[y1:y2, max(x1, x2 - thick) : x2], own[y1 : min(y2, y1 + thick), x1:x2], own[max(y1, y2 - thick) : y2, x1:x2]):
                        part[:] = colour
                made.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *batch.columns[-3:-1], pa.array(made, pa.binary())], [*keep, "w", "h", "pixels"])

    given = pictures.select(*keep, "pixels", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "boxes")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-4])
    return given.mapInArrow(look, f"{kinds}, w int, h int, pixels binary")
