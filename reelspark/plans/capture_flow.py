"""The whole of capture: sampled frames, persons and their faces, the accept rule, crops, and the hit index."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crops, images, scores, vectors
from .bridge import view, with_views
from .catalogue import DOT, ORACLE, QUERIES
from .detail import _A, _B, _FD7

BOX = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class CaptureSpec:
    ratio: str = "2:3"
    stride: int = 2
    min_conf: float = 0.35
    face_most: float = 0.32
    body_most: float = 0.38
    combine: str = "min"
    min_sharpness: float = 0.0
    rate: float = 30.0


def _fixed_vector(v: list[float]):
    return F.array(*[F.lit(float(x)) for x in v])


def matches(frames: DataFrame, persons: DataFrame, faces: DataFrame, face_ref: list[float] | None, body_ref: list[float] | None, spec: CaptureSpec = CaptureSpec()) -> DataFrame:
    """video_id, frame_idx, person, w, h, score, fd, rd and the crop (x1, y1, x2, y2, whole numbers) of each person that is accepted.

    frames: video_id, frame_idx, w, h. persons: video_id, frame_idx, person, x1, y1, x2, y2,
    conf, body (a vector or null). faces: video_id, frame_idx, person, face, x1, y1, x2, y2
    inside the person's box, vec. A person's face is the nearest one to the reference (of
    equal ones the smaller `face`); a face without a vector does not count. Persons and
    frames with a null key, confidence, coordinate or size match nothing. Without a reference its distance is null.
    """
    own, key = ["video_id", "frame_idx"], ["video_id", "frame_idx", "person"]
    sampled = frames.where(F.pmod("frame_idx", F.lit(max(1, spec.stride))) == 0).select(*own, F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    whole = lambda names: functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in names])
    found = persons.where((F.col("conf") >= spec.min_conf) & whole(BOX)).select(*key, *[F.col(c).cast("long").cast("double").alias(c) for c in BOX], "body").join(sampled.where(whole(("w", "h"))), own)
    zero = F.lit(0.0)
    found = found.withColumns({"x1": F.greatest(zero, F.col("x1")), "y1": F.greatest(zero, F.col("y1")), "x2": F.least(F.col("w") - 1, F.col("x2")), "y2": F.least(F.col("h") - 1, F.col("y2"))})
    found = found.where((F.col("x2") > F.col("x1") + 2) & (F.col("y2") > F.col("y1") + 2))
    if face_ref is None:
        found = found.withColumns({"fd": F.lit(None).cast("double"), **{f"f{c}": F.lit(None).cast("double") for c in BOX}})
    else:
        near = vectors.face_distance(F.col("vec"), _fixed_vector(face_ref))
        each = faces.where(F.col("vec").isNotNull()).select(*key, F.struct(near.alias("fd"), "face", *[F.col(c).cast("double").alias(f"f{c}") for c in BOX]).alias("f"))
        best = each.groupBy(*key).agg(F.min_by("f", F.struct("f.fd", "f.face")).alias("f"))
        found = found.join(best.select(*key, "f.fd", *[f"f.f{c}" for c in BOX]), key, "left")
    rd = F.lit(None).cast("double") if body_ref is None else vectors.plain_distance(F.col("body"), _fixed_vector(body_ref))
    found = found.withColumn("rd", rd).drop("body").where(scores.accepted(F.col("fd"), F.col("rd"), spec.face_most, spec.body_most))
    fw, fh = F.col("fx2") - F.col("fx1"), F.col("fy2") - F.col("fy1")
    anchor = [F.coalesce(F.col(low) + (F.col(f"f{low}") + F.col(f"f{high}")) / 2.0, F.col(low) + F.col(size) * 0.5) for low, high, size in (("x1", "x2", "_w"), ("y1", "y2", "_h"))]
    bias = F.coalesce(-(0.9 * (F.greatest(F.lit(1.0), fh) / F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")))), zero)
    fits = float(spec.ratio.split(":")[0]) / float(spec.ratio.split(":")[1])
    grown = crops.expand_to_ratio(found.withColumn("score", scores.combined(F.col("fd"), F.col("rd"), spec.combine)), fits, F.col("w"), F.col("h"), tuple(anchor), F.when(F.col("fx1").isNotNull(), bias).otherwise(0.0))
    placed = crops.enforce_scale(grown, fits, F.col("w"), F.col("h"), (fw, fh))
    return placed.select(*key, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "score", "fd", "rd", *[F.col(c).cast("long").alias(c) for c in BOX])


def cropped(found: DataFrame, frames: DataFrame, spec: CaptureSpec = CaptureSpec()) -> DataFrame:
    """Matches with the gray pixels of their crop (pixels, crop_w, crop_h) and its sharpness, those below the least sharpness left out.

    frames: video_id, frame_idx and pixels (a byte each). Only the frames of matches are met.
    """
    met = found.join(frames.select("video_id", "frame_idx", "pixels"), ["video_id", "frame_idx"])
    cut = images.cut_out(met.withColumn("own", F.struct(*found.columns)), ["own"], channels=1)
    seen = images.measure(cut.withColumn("held", F.struct("own", "w", "h", "pixels")), ["held"])
    made = seen.select("held.own.*", F.col("held.pixels").alias("pixels"), F.col("held.w").alias("crop_w"), F.col("held.h").alias("crop_h"), F.coalesce("sharpness", F.lit(0.0)).alias("sharpness"))
    return made.where(F.col("sharpness") >= spec.min_sharpness) if spec.min_sharpness > 0 else made


def hit_index(found: DataFrame, spec: CaptureSpec = CaptureSpec()) -> DataFrame:
    """The rows of the hit index; persons of one frame share the name of its crop. A missing distance is an empty text."""
    four = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), scores.decimals(F.col(c), 4)), F.lit(""))
    seconds = scores.decimals(F.col("frame_idx") / spec.rate, 3)
    return found.select("video_id", F.col("frame_idx").alias("frame"), "person", seconds.alias("time_secs"), four("score").alias("score"), four("fd").alias("face_dist"), four("rd").alias("reid_dist"), *BOX, F.format_string("f%08d.jpg", "frame_idx").alias("crop_path"))


_MOVED = "CASE WHEN {low} < 0 THEN -({low}) WHEN {high} > {size} THEN {size} - ({high}) ELSE 0e0 END"


def _inside(low: str, high: str, size: str) -> tuple[str, str]:
    move = _MOVED.format(low=low, high=high, size=size)
    first = f"greatest(0e0, least({size} - 1, round_even({low} + {move}, 0)))"
    return first, f"greatest({first} + 1, least({size}, round_even({high} + {move}, 0)))"


_XS, _YS = _inside("((x1 + x2) / 2e0 - n * t / 2e0)", "((x1 + x2) / 2e0 + n * t / 2e0)", "w"), _inside("((y1 + y2) / 2e0 - n / 2e0)", "((y1 + y2) / 2e0 + n / 2e0)", "h")
_CUT = "greatest(0e0, least({size} - 1, {v}))"
_SQL = f"""WITH nearest AS (SELECT CAST(floor(a.id / 2e0) AS BIGINT) AS person, (10 + a.id * 7 % 60) * 1e0 AS fx1, (5 + a.id * 3 % 40) * 1e0 AS fy1, (30 + a.id * 7 % 60 + a.id % 37) * 1e0 AS fx2, (29 + a.id * 3 % 40 + a.id % 41) * 1e0 AS fy2, {_FD7} AS fd
  FROM v_vec a JOIN v_vec b ON b.id = 7 WHERE a.id % 5 <> 0 AND a.id % 8 >= 2 QUALIFY row_number() OVER (PARTITION BY CAST(floor(a.id / 2e0) AS BIGINT) ORDER BY {_FD7}, a.id) = 1),
bodies AS (SELECT a.id AS person, 1 - {DOT} / ({_A} * {_B}) AS rd FROM v_vec a JOIN v_vec b ON b.id = 11 WHERE a.id % 6 <> 0),
boxes AS (SELECT *, 480e0 + 16 * (frame % 3) AS w, 270e0 AS h FROM v_person WHERE conf >= 0.35e0 AND frame % 2 = 0),
whole AS (SELECT frame, id, w, h, greatest(0e0, trunc(x1)) AS x1, greatest(0e0, trunc(y1)) AS y1, least(w - 1, trunc(x2)) AS x2, least(h - 1, trunc(y2)) AS y2 FROM boxes),
met AS (SELECT o.*, n.* EXCLUDE (person), rd, 2e0 / 3e0 AS t, greatest(1e0, x2 - x1) AS bw, greatest(1e0, y2 - y1) AS bh FROM whole o LEFT JOIN nearest n ON n.person = o.id LEFT JOIN bodies b ON b.person = o.id
  WHERE x2 > x1 + 2 AND y2 > y1 + 2 AND (coalesce(fd <= 0.9e0, false) OR coalesce(rd <= 0.95e0, false))),
grown AS (SELECT *, coalesce(x1 + (fx1 + fx2) / 2e0, x1 + bw * 0.5e0) AS cx, coalesce(y1 + (fy1 + fy2) / 2e0, y1 + bh * 0.5e0) - CASE WHEN fx1 IS NULL THEN 0e0 ELSE -(0.9e0 * (greatest(1e0, fy2 - fy1) / greatest(1e0, y2 - y1))) END * bh AS cy,
  CASE WHEN bw / bh < t THEN bh * t ELSE bw END * 0.5e0 AS ex, CASE WHEN bw / bh < t THEN bh ELSE bw / t END * 0.5e0 AS ey FROM met),
cut AS (SELECT *, {_CUT.format(size='w', v='cx - ex')} AS a, {_CUT.format(size='h', v='cy - ey')} AS b, {_CUT.format(size='w', v='cx + ex')} AS c, {_CUT.format(size='h', v='cy + ey')} AS d FROM grown),
moved AS (SELECT *, CASE WHEN (c - a) / nullif(d - b, 0) - t > 1e-4 THEN ((c - a) - (d - b) * t) * 0.5e0 ELSE 0e0 END AS mx, CASE WHEN (c - a) / nullif(d - b, 0) - t < -1e-4 THEN ((d - b) - (c - a) / t) * 0.5e0 ELSE 0e0 END AS my, c - a <= 1 OR d - b <= 1 AS tiny FROM cut),
fitted AS (SELECT * EXCLUDE (x1, y1, x2, y2), {", ".join(f"CASE WHEN tiny THEN floor({v}) ELSE round_even({_CUT.format(size=s, v=f'{v} {sign} {m}')}, 0) END AS {c}" for c, v, sign, m, s in (("x1", "a", "+", "mx", "w"), ("y1", "b", "+", "my", "h"), ("x2", "c", "-", "mx", "w"), ("y2", "d", "-", "my", "h")))} FROM moved),
needs AS (SELECT *, greatest(y2 - y1, 0.28e0 * h, (fy2 - fy1) / 0.42e0, ((fx2 - fx1) + 0.6e0 * (fx2 - fx1)) / t) AS need FROM fitted),
sized AS (SELECT *, CASE WHEN y2 - y1 + 0.5e0 < need THEN need WHEN y2 - y1 > greatest((fy2 - fy1) / 0.18e0, need) + 0.5e0 THEN greatest((fy2 - fy1) / 0.18e0, need) END AS n FROM needs)
SELECT frame % 3 AS video_id, frame, id AS person, printf('%.3f', frame / 25e0) AS time_secs, printf('%.4f', CASE WHEN fd IS NULL THEN rd WHEN rd IS NULL THEN fd ELSE least(fd, rd) END) AS score, coalesce(printf('%.4f', fd), '') AS face_dist, coalesce(printf('%.4f', rd), '') AS reid_dist,
{", ".join(f"CAST(CASE WHEN n IS NULL THEN {c} ELSE {v} END AS BIGINT) AS {c}" for c, v in (("x1", _XS[0]), ("y1", _YS[0]), ("x2", _XS[1]), ("y2", _YS[1])))}, printf('f%08d.jpg', frame) AS crop_path FROM sized"""


def capture_flow(spark, sf_dir: str) -> DataFrame:
    """Capture from frames to the hit index. Persons are parts, faces and bodies are vectors; the places of faces and the references are chosen by id."""
    people, vecs = view(spark, sf_dir, "v_person"), view(spark, sf_dir, "v_vec")
    video, i = F.pmod("frame", F.lit(3)).alias("video_id"), F.col("id")
    frames = people.select("frame").distinct().select(video, F.col("frame").alias("frame_idx"), (480 + 16 * F.pmod("frame", F.lit(3))).alias("w"), F.lit(270).alias("h"))
    bodies = vecs.where(i % 6 != 0).select("id", F.col("embedding").alias("body"))
    persons = people.join(bodies, "id", "left").select(video, F.col("frame").alias("frame_idx"), i.alias("person"), *BOX, "conf", "body")
    left, top = 10 + i * 7 % 60, 5 + i * 3 % 40
    owner = people.select(video, F.col("frame").alias("frame_idx"), i.alias("person"))
    faces = vecs.select(F.floor(i / 2).alias("person"), i.alias("face"), left.alias("x1"), top.alias("y1"), (left + 20 + i % 37).alias("x2"), (top + 24 + i % 41).alias("y2"), F.when((i % 5 != 0) & (i % 8 >= 2), F.col("embedding")).alias("vec")).join(owner, "person")
    refs = {r.id: list(r.embedding) for r in vecs.where(i.isin(7, 11)).select("id", "embedding").collect()}  # two rows
    spec = CaptureSpec(face_most=0.9, body_most=0.95, rate=25.0)
    return hit_index(matches(frames, persons, faces, refs.get(7), refs.get(11), spec), spec)


QUERIES["capture_flow"], ORACLE["capture_flow"] = capture_flow, with_views(_SQL)
