"""Crop geometry over DataFrames whose rows hold a box in x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import clamp, shift_inside
from .vectors import bound


def expand_to_ratio(boxes: DataFrame, ratio: float, width: float, height: float, anchor: tuple[Column, Column] | None = None, head_bias: Column | float = 0.0) -> DataFrame:
    """Replaces each box by one of that ratio inside the frame: grown about its anchor, cut at the frame, then shrunk where the cut broke the ratio."""
    across, down = anchor or (F.col("x1") + F.col("_w") * 0.5, F.col("y1") + F.col("_h") * 0.5)
    sized = boxes.withColumns({"_w": F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")), "_h": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))})
    sized = sized.withColumns({"_cx": across, "_cy": down - F.lit(head_bias) * F.col("_h")})
    narrow = F.col("_w") / F.col("_h") < ratio
    sized = sized.withColumns({"_ex": F.when(narrow, F.col("_h") * ratio).otherwise(F.col("_w")) * 0.5, "_ey": F.when(narrow, F.col("_h")).otherwise(F.col("_w") / ratio) * 0.5})
    sides = [(c, clamp(F.col(m) + sign * F.col(e), 0.0, size - 1.0)) for c, m, e, sign, size in (("_x1", "_cx", "_ex", -1, width), ("_y1", "_cy", "_ey", -1, height), ("_x2", "_cx", "_ex", 1, width), ("_y2", "_cy", "_ey", 1, height))]
    cut = sized.withColumns(dict(sides)).withColumns({"_cw": F.col("_x2") - F.col("_x1"), "_ch": F.col("_y2") - F.col("_y1")})
    off = F.col("_cw") / F.nullif(F.col("_ch"), F.lit(0.0)) - ratio
    cut = cut.withColumn("_mx", F.when(off > 1e-4, (F.col("_cw") - F.col("_ch") * ratio) * 0.5).otherwise(0.0)).withColumn("_my", F.when(off < -1e-4, (F.col("_ch") - F.col("_cw") / ratio) * 0.5).otherwise(0.0))
    tiny = (F.col("_cw") <= 1) | (F.col("_ch") <= 1)
    final = {c: F.when(tiny, F.floor(F.col(f"_{c}"))).otherwise(F.rint(clamp(F.col(f"_{c}") + sign * F.col(m), 0.0, size - 1.0))).cast("double") for c, m, sign, size in (("x1", "_mx", 1, width), ("y1", "_my", 1, height), ("x2", "_mx", -1, width), ("y2", "_my", -1, height))}
    return cut.select(*[final[c].alias(c) if c in final else F.col(c) for c in boxes.columns])


def enforce_scale(boxes: DataFrame, ratio: float, width: float, height: float, face: tuple[Column, Column], face_most: float = 0.42, margin: float = 0.30, least: float = 0.28, face_least: float = 0.18) -> DataFrame:
    """Resizes crops in which the face (its width and height are given, null for none) or the frame's share would be out of bounds."""
    fw, fh = face
    tall = boxes.withColumn("_h", F.col("y2") - F.col("y1"))
    tall = tall.withColumn("_need", F.greatest(F.col("_h"), F.lit(least * height), fh / face_most, (fw + 2.0 * margin * fw) / ratio))
    tall = tall.withColumn("_most", F.coalesce(F.greatest(fh / face_least, F.col("_need")), F.lit(float("inf"))))
    tall = tall.withColumn("_new", F.when(F.col("_h") + 0.5 < F.col("_need"), F.col("_need")).when(F.col("_h") > F.col("_most") + 0.5, F.col("_most")))
    final = {}
    for low, high, half, size in (("x1", "x2", F.col("_new") * ratio / 2.0, width), ("y1", "y2", F.col("_new") / 2.0, height)):
        middle = (F.col(low) + F.col(high)) / 2.0
        a, b = shift_inside(middle - half, middle + half, size)
        final |= {low: F.when(F.col("_new").isNull(), F.col(low)).otherwise(a), high: F.when(F.col("_new").isNull(), F.col(high)).otherwise(b)}
    return tall.select(*[final[c].alias(c) if c in final else F.col(c) for c in boxes.columns])


def letterbox(width: Column, height: Column, size: int = 640) -> dict[str, Column]:
    """Scale and offsets that centre a picture in a square."""
    scale = F.least(size / width, size / height)
    return {"scale": scale, "dx": F.floor((size - F.rint(width * scale)) / 2), "dy": F.floor((size - F.rint(height * scale)) / 2)}


def even_size(width: Column, ratio: Column) -> tuple[Column, Column]:
    even = width.bitwiseAND(F.lit(-2))
    return even, F.greatest(F.lit(2), F.floor(even * ratio).bitwiseAND(F.lit(-2)))


def affine_box(m: tuple[float, ...], x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """The upright box around a box taken back through the 2x3 matrix m, on whole pixels."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    xs = [(e * (x - c) - b * (y - f)) / det for x in (x1, x2) for y in (y1, y2)]
    ys = [(a * (y - f) - d * (x - c)) / det for x in (x1, x2) for y in (y1, y2)]
    return [F.floor(F.least(*xs)), F.floor(F.least(*ys)), F.ceil(F.greatest(*xs)), F.ceil(F.greatest(*ys))]


def ordered_landmarks(points: Column) -> Column:
    """Five points as left eye, right eye, nose, left and right mouth corner; null if they cannot be a face."""
    pair = lambda v, at: F.array_sort(F.transform(F.slice(v, at, 2), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    nose = lambda v: F.struct(F.get(v, F.lit(2))["x"].alias("x"), F.get(v, F.lit(2))["y"].alias("y"))
    finite = F.forall(points, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    usable = F.when((F.size(points) == 5) & finite, F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))))

    def checked(placed: Column) -> Column:
        at = lambda i, k: F.get(placed, F.lit(i))[k]
        level = (at(2, "y") > F.greatest(at(0, "y"), at(1, "y"))) & (at(2, "y") < F.least(at(3, "y"), at(4, "y")))
        return F.when((at(0, "x") < at(1, "x")) & (at(3, "x") < at(4, "x")) & level, placed)

    return bound(usable, lambda v: bound(F.concat(pair(v, 1), F.array(nose(v)), pair(v, 4)), checked))


def yaw_roll(points: Column) -> tuple[Column, Column]:
    """Degrees of yaw and roll of ordered landmarks; 0 without them."""
    le, re, nose = (F.get(points, F.lit(i)) for i in range(3))
    wide, tall = re["x"] - le["x"], re["y"] - le["y"]
    yaw = F.degrees(F.atan2(nose["x"] - (le["x"] + re["x"]) / 2, F.hypot(wide, tall) + 1e-6))
    return F.coalesce(yaw, F.lit(0.0)), F.coalesce(F.degrees(F.atan2(tall, wide)), F.lit(0.0))


def levelling(angle: Column) -> Column:
    """The turn that levels an eye line: none under 8 degrees, a quarter beyond 80."""
    folded = F.when(angle < -90, angle + 180).when(angle > 90, angle - 180).otherwise(angle)
    return F.when(F.abs(folded) < 8, 0.0).when(folded > 80, 90.0).when(folded < -80, -90.0).otherwise(folded)


def frame_rate(text: Column) -> Column:
    """Frames a second of "25" or "30000/1001"; a zero divisor counts as 1, what is no number gives 30."""
    parts = F.split(text, "/")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    below = F.when(F.size(parts) < 2, 1.0).otherwise(F.when(number(1) == 0, 1.0).otherwise(number(1)))
    return F.coalesce(number(0) / below, F.lit(30.0))


def unletterbox(box: tuple[Column, Column, Column, Column], width: Column, height: Column, size: int = 640) -> list[Column]:
    """A box on the centred square canvas in pixels of the picture itself, at least one pixel wide and high."""
    placed = letterbox(width, height, size)
    grow = 1.0 / F.greatest(placed["scale"], F.lit(1e-6))
    at = lambda v, d: F.rint((v - placed[d]) * grow)
    low = [F.greatest(F.lit(0.0), F.least(limit, at(v, d))) for v, d, limit in ((box[0], "dx", width), (box[1], "dy", height))]
    high = [F.greatest(first + 1, F.least(limit, at(v, d))) for v, d, limit, first in ((box[2], "dx", width, low[0]), (box[3], "dy", height, low[1]))]
    return [*low, *high]


def detector_sizes(wanted: Column, longest: Column, cap: int = 2048) -> dict[str, Column]:
    """Detector input sizes: the plain one, and those for a quarter and a half turn; multiples of 32."""
    up = lambda v: (F.ceil(v / 32) * 32).cast("long")
    plain = up(F.greatest(F.lit(320), wanted))
    turned = lambda share: F.least(up(F.greatest(plain, F.floor(longest * share))), F.greatest(F.lit(cap), plain))
    return {"plain": plain, "quarter": turned(0.75), "half": turned(0.67)}


def kept_share(width: Column, height: Column, ratio: float) -> Column:
    """The share of a crop grown to a ratio that the box itself fills."""
    return F.when(width / height < ratio, width / (height * ratio)).otherwise(height * ratio / width)


def aspect(text: Column) -> tuple[Column, Column]:
    """Width and height of a ratio given as "W:H"; nulls for what is none."""
    parts = F.split(text, ":")
    return tuple(F.when(F.size(parts) == 2, F.get(parts, F.lit(i)).try_cast("double")) for i in (0, 1))
