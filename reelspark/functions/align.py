"""Face chips: a similarity transform from five points to a template, robust to a misplaced one, and the warp by it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import block_mean

#: Eyes, nose and corners of the mouth in a chip of 112 x 112 pixels (fixed values).
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
SIDE = 112


def least_squares(points: np.ndarray, goal: np.ndarray) -> np.ndarray | None:
    """The 2 x 3 similarity (turn, scale, shift) that brings points nearest to goal; none if the points coincide.

    As complex numbers: goal = m * point + t, where m is the covariance over the variance.
    """
    p, g = points @ (1, 1j), goal @ (1, 1j)
    centred = p - p.mean()
    spread = float((np.abs(centred) ** 2).sum())
    if not np.isfinite(spread) or spread < 1e-9:
        return None
    m = (centred.conj() * (g - g.mean())).sum() / spread
    t = g.mean() - m * p.mean()
    return np.array([[m.real, -m.imag, t.real], [m.imag, m.real, t.imag]])


def similarity(points: np.ndarray, goal: np.ndarray) -> np.ndarray | None:
    """The transform of the pair of points whose median squared error over all points is least, fitted again to the points that agree with it."""
    best, error, homogeneous = None, np.inf, np.column_stack([points, np.ones(len(points))])
    miss = lambda m: ((homogeneous @ m.T - goal) ** 2).sum(axis=1)
    for pair in combinations(range(len(points)), 2):
        made = least_squares(points[list(pair)], goal[list(pair)])
        if made is not None and (median := float(np.median(miss(made)))) < error:
            best, error = made, median
    if best is None:
        return None
    # the usual robust deviation of a median of squares, for a model fixed by two points
    limit = 2.5 * 1.4826 * (1 + 5 / max(1, len(points) - 2)) * np.sqrt(error)
    agree = miss(best) <= max(limit, 1e-3) ** 2
    refined = least_squares(points[agree], goal[agree]) if agree.sum() >= 2 else None
    return best if refined is None else refined


def bilinear(picture: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of a picture [row, column, channel] between its pixels; beyond the edge it is mirrored, the edge pixel included."""

    def mirrored(i: np.ndarray, n: int) -> np.ndarray:
        i = np.mod(i, 2 * n)
        return np.where(i < n, i, 2 * n - 1 - i)

    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    at = lambda dx, dy: picture[mirrored(y0 + dy, picture.shape[0]), mirrored(x0 + dx, picture.shape[1])].astype(np.float64)
    return (at(0, 0) * (1 - fx) + at(1, 0) * fx) * (1 - fy) + (at(0, 1) * (1 - fx) + at(1, 1) * fx) * fy


def chip(picture: np.ndarray, points: np.ndarray | None, side: int = SIDE) -> np.ndarray:
    """side x side pixels with the five points on the template; the whole picture resized if no transform fits (all points, then the first three)."""
    goal = np.array(TEMPLATE) * side / SIDE
    made = None
    if points is not None:
        made = similarity(points, goal)
        made = similarity(points[:3], goal[:3]) if made is None else made
    if made is not None and abs(np.linalg.det(made[:, :2])) > 1e-12:
        back = np.linalg.inv(made[:, :2])
        y, x = np.mgrid[:side, :side].astype(np.float64)
        x, y = x - made[0, 2], y - made[1, 2]
        out = bilinear(picture, back[0, 0] * x + back[0, 1] * y, back[1, 0] * x + back[1, 1] * y)
    elif max(picture.shape[:2]) > side:
        out = np.stack([block_mean(picture[:, :, c], side, side) for c in range(picture.shape[2])], axis=2)
    else:
        h, w = picture.shape[:2]
        y, x = np.mgrid[:side, :side].astype(np.float64)
        clip = lambda v, n: np.clip((v + 0.5) * n / side - 0.5, 0, n - 1)
        out = bilinear(picture, clip(x, w), clip(y, h))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def aligned(pictures: DataFrame, keep: list[str], channels: int = 3, side: int = SIDE) -> DataFrame:
    """keep, w, h and pixels of chips of raw pictures (pixels, w, h; `channels` bytes a pixel) with their points, five x, y pairs in one array.

    Missing or not finite points, or not ten numbers, leave the picture as it stands in the chip. A null or short picture gives null pixels.
    """

    def look(batches):
        for batch in batches:
            made = []
            for raw, w, h, points in zip(*(c.to_pylist() for c in batch.columns[-4:])):
                if not raw or not w or not h or w < 0 or h < 0 or len(raw) < w * h * channels:
                    made.append(None)
                    continue
                known = points is not None and len(points) == 10 and all(p is not None and np.isfinite(p) for p in points)
                own = np.frombuffer(raw, np.uint8, w * h * channels).reshape(h, w, channels)
                made.append(chip(own, np.array(points, float).reshape(5, 2) if known else None, side).tobytes())
            sides = pa.array([None if m is None else side for m in made], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], sides, sides, pa.array(made, pa.binary())], [*keep, "w", "h", "pixels"])

    given = pictures.select(*keep, "pixels", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.col("points").cast("array<double>").alias("points"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-4])
    return given.mapInArrow(look, f"{kinds}w int, h int, pixels binary")
