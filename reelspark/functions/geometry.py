"""Box geometry as column expressions. A box is given by its columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x1, y1, x2, y2; 0 if the union is empty."""
    common = area(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))
    union = area(a["x1"], a["y1"], a["x2"], a["y2"]) + area(b["x1"], b["y1"], b["x2"], b["y2"]) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def shift_inside(low: Column, high: Column, size: float) -> tuple[Column, Column]:
    """Moves an interval into [0, size]: an overhang at 0 is mended first, then one at the end; the result is rounded and clamped to at least 1 wide."""
    move = F.when(low < 0, -low).when(high > size, size - high).otherwise(F.lit(0.0))
    a = clamp(F.rint(low + move), 0.0, size - 1)
    return a, F.greatest(a + 1, F.least(F.rint(high + move), F.lit(size)))


def round_up(v: Column, step: int) -> Column:
    return F.ceil(v / step) * step


def rotated_back(x: Column, y: Column, degrees: Column, width: float, height: float) -> tuple[Column, Column]:
    """Where a point of a turned frame lies in the upright frame of that size."""
    return (
        F.when(degrees == 90, y).when(degrees == 180, width - 1 - x).when(degrees == 270, width - 1 - y).otherwise(x),
        F.when(degrees == 90, height - 1 - x).when(degrees == 180, height - 1 - y).when(degrees == 270, x).otherwise(y),
    )


def rotated_box_back(box: tuple[Column, Column, Column, Column], degrees: Column, width: float, height: float) -> list[Column]:
    """The upright box, in the upright frame, of a box found in a turned one."""
    (xa, ya), (xb, yb) = (rotated_back(x, y, degrees, width, height) for x, y in (box[:2], box[2:]))
    return [F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb)]


def face_share(y1: Column, y2: Column, crop_height: Column) -> Column:
    """A face's height as a share of its crop's; 0 without a face."""
    return F.when(y1.isNotNull() & y2.isNotNull(), F.greatest(F.lit(1.0), y2 - y1) / F.greatest(F.lit(1.0), crop_height)).otherwise(0.0)


def border_share(box: tuple[Column, Column, Column, Column], width: float, height: float) -> Column:
    """The share of a picture outside its content box, whose last two numbers may be a corner or a size: the larger reading counts. 0 without a box."""
    x, y, a, b = box

    def held(right: Column, bottom: Column) -> Column:
        w = clamp(right, 0.0, width) - clamp(x, 0.0, width)
        h = clamp(bottom, 0.0, height) - clamp(y, 0.0, height)
        return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)

    corner = F.when((a > x) & (b > y), held(a, b)).otherwise(0.0)
    size = F.when((a > 0) & (b > 0), held(x + a, y + b)).otherwise(0.0)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull() & a.isNotNull() & b.isNotNull(), clamp(1 - F.greatest(corner, size) / max(1.0, width * height), 0.0, 1.0)), F.lit(0.0))


def corner_marks(x: Column, y: Column, w: Column, h: Column, width: Column | float, height: Column | float) -> Column:
    """Whether a region looks like text in a corner of the picture: it touches a corner square, is 1.5 to 12 times as wide as high and not tiny."""
    width, height = F.lit(width), F.lit(height)
    side = F.greatest(F.lit(1).cast("long"), F.floor(0.22 * F.least(width, height)))
    across, down = (x < side) | (x + w > width - side), (y < side) | (y + h > height - side)
    shape = (w / (h + 1e-6)).between(1.5, 12.0)
    return across & down & shape & (w * h >= 80)
