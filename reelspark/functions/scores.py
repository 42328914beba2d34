"""Scores and classes of candidate images as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp


def quality(fd: Column, sharp: Column, exposure: Column, face_quality: Column, mark: Column, border: Column) -> Column:
    identity = clamp(1 - F.greatest(F.lit(0.0), fd) / 0.5, 0.0, 1.0)
    base = 0.45 * identity + 0.30 * sharp + 0.20 * exposure + 0.05 * F.least(F.lit(1.0), face_quality / 1200.0)
    base = base * F.greatest(F.lit(0.0), 1 - 0.6 * mark) * F.greatest(F.lit(0.0), 1 - 0.6 * clamp(border, 0.0, 0.4))
    return clamp(base, 0.0, 1.0)


def boosted(q: Column, face_frac: Column, boost: float = 0.25, start: float = 0.33) -> Column:
    """Quality with a bonus that grows with the face above `start`."""
    if boost <= 1e-6:
        return clamp(q, 0.0, 1.0)
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), face_frac - start) / max(1e-6, 1 - start))
    return clamp(q * (1 + boost * ramp), 0.0, 1.5)


def ratio_class(w: Column, h: Column) -> Column:
    r = w / h
    return (
        F.when(r.between(0.60, 0.70), "2:3").when((r > 0.70) & (r <= 0.82), "3:4").when(r.between(0.95, 1.05), "1:1")
        .when(r.between(1.40, 1.70), "3:2").when(r < 0.60, "narrow").when(r > 1.70, "wide").otherwise("other")
    )


def category(ratio: Column, face: Column) -> Column:
    upright = F.when(face >= 0.33, "closeup").when(face >= 0.22, "portrait").when(face >= 0.12, "cowboy").otherwise("full")
    flat = F.when(face >= 0.30, "closeup")
    return F.when(ratio.isin("2:3", "3:4"), upright).when(ratio.isin("3:2", "wide"), flat.otherwise("wide")).when(ratio == "1:1", flat.otherwise("portrait")).otherwise("portrait")


def combined(face: Column, body: Column, mode: str = "min") -> Column:
    """One distance from two that may be null."""
    if mode == "avg":
        return F.when(face.isNull(), body).when(body.isNull(), face).otherwise((face + body) / 2)
    if mode == "face_priority":
        return F.when(face.isNull(), body).otherwise(0.7 * face + 0.3 * F.coalesce(body, F.lit(0.5)))
    return F.least(face, body)


def accepted(face: Column, body: Column, face_most: float, body_most: float) -> Column:
    hit = F.coalesce(face <= face_most, F.lit(False)) | F.coalesce(body <= body_most, F.lit(False))
    return F.coalesce(face, body).isNotNull() & hit


def matched(face: Column, body: Column, mode: str, face_most: float, body_most: float) -> Column:
    """Proposed match modes: either, both, face_only or reid_only; a missing distance does not match."""
    by_face, by_body = F.coalesce(face <= face_most, F.lit(False)), F.coalesce(body <= body_most, F.lit(False))
    return {"either": by_face | by_body, "both": by_face & by_body, "face_only": by_face, "reid_only": by_body}[mode]


def probe_confidence(base: Column, cap: float = 0.20) -> Column:
    """The confidence asked of a cheap first look."""
    return F.least(base, F.lit(cap))


def turned_confidence(base: Column, degrees: Column) -> Column:
    """The confidence asked of a look at a turned frame: lower for a half turn than for a quarter."""
    return F.greatest(F.lit(0.10), base * F.when(degrees.isin(90, 270), 0.8).otherwise(0.6))


def central_score(conf: Column, cx: Column, cy: Column, width: float, height: float) -> Column:
    """Confidence less the distance from the picture's middle; without confidence the distance alone."""
    far = F.hypot(cx - width / 2, cy - height / 2)
    return F.when(conf.isNull(), -far).otherwise(0.7 * conf - 0.3 * far / (width**2 + height**2) ** 0.5)


def decimals(v: Column, places: int) -> Column:
    """Text with that many decimals; what lies exactly halfway goes to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(v, places))


def time_from_name(name: Column) -> Column:
    """Time from a file name: seconds first, then a frame number, then the last long run of digits."""
    seconds = F.regexp_extract(name, r"(?i)(?:t|time)[_\-:]?(\d+(?:\.\d+)?)\s*s", 1)
    frame = F.regexp_extract(name, r"(?i)\b(?:frame|f|img|i)[_\-]?\s*(\d{3,})(?!\d)", 1)
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(name, F.lit(r"(\d{3,})"))), -1)
    return F.coalesce(*[F.when(x != "", x) for x in (seconds, frame, last)]).cast("double")
