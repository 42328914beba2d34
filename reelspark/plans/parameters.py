"""Parameters of curation: a preset or override, then the environment, then the default, each brought within bounds."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.selection import QUOTAS, Quotas


@dataclass(frozen=True)
class Parameters:
    scene_aware: bool = True
    scene_similarity: float = 0.92
    scene_gap: float = 4.0
    scene_window: int = 64
    most_bits: int = 7
    scene_bits: int = 8
    soft_cap: int = 0
    soft_penalty: float = 0.08
    alpha: float = 0.75
    profile_yaw: float = 50.0
    ground_weight: float = 1.0
    face_weight: float = 0.6
    closeup_boost: float = 0.25
    closeup_from: float = 0.33
    fd_max: float = 0.45
    sharp_min: float = 0.10
    no_vector: float = 0.10
    most: int = 200
    by_category: tuple[tuple[str, int, int], ...] = QUOTAS

    def quotas(self) -> Quotas:
        return Quotas(self.by_category, self.most, self.alpha, self.most_bits, self.soft_cap, self.soft_penalty, self.no_vector)


#: Names in the environment; of several the first that holds a number counts (fixed values).
NAMES = {
    "scene_aware": ("PC_SCENE_AWARE",), "scene_similarity": ("PC_SCENE_SIM",), "scene_gap": ("PC_SCENE_TIME_GAP",), "scene_window": ("PC_SCENE_NN_WINDOW",),
    "most_bits": ("PC_DEDUP_HAMM",), "scene_bits": ("PC_SCENE_DEDUP",), "soft_cap": ("PC_SCENE_SOFT_CAP",), "soft_penalty": ("PC_SCENE_SOFT_PENALTY", "PC_SCENE_SOFT_BONUS"),
    "alpha": ("PC_MMR_ALPHA",), "profile_yaw": ("PC_PROFILE_YAW",), "ground_weight": ("PC_DIV_BG",), "face_weight": ("PC_DIV_FACE",), "closeup_boost": ("PC_CLOSEUP_BOOST",),
    "closeup_from": ("PC_CLOSEUP_THR",), "fd_max": ("PC_FD_MAX",), "sharp_min": ("PC_SHARP_MIN",), "no_vector": ("PC_NO_EMBED_PENALTY",),
}
#: Bounds besides 0 as the least; similarity and gap have none.
SHARES = {"alpha", "closeup_from", "sharp_min"}
FREE = {"scene_similarity", "scene_gap"}


def _number(text: str | None) -> float | None:
    try:
        return float(text.strip()) if text else None
    except ValueError:
        return None


def resolve(given: Mapping[str, object] = {}, environment: Mapping[str, str] = {}) -> Parameters:
    """Parameters from overrides by field name, then from the environment, then the defaults."""
    found = {}
    for f in fields(Parameters):
        value, default = given.get(f.name), f.default
        if value is None and f.name in NAMES:
            if isinstance(default, bool):
                text = environment.get(NAMES[f.name][0])
                value = None if text is None else text.lower() not in {"0", "false", "no"}
            else:
                value = next((n for k in NAMES[f.name] if (n := _number(environment.get(k))) is not None), None)
        value = default if value is None else value
        if isinstance(default, bool):
            value = bool(value)
        elif isinstance(default, (int, float)):
            value = type(default)(value)
            value = value if f.name in FREE else max(0, min(1, value)) if f.name in SHARES else max(0, value)
            value = type(default)(value)
        found[f.name] = value
    return Parameters(**found)


def quotas(text: str) -> tuple[tuple[str, int, int], ...]:
    """Quotas from a JSON object of [least, most] by category, in its order."""
    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("quotas must be a JSON object")
    for name, pair in raw.items():
        if not isinstance(pair, list) or len(pair) != 2:
            raise ValueError(f"quota {name!r} must be [least, most], not {pair!r}")
    return tuple((name, int(least), int(most)) for name, (least, most) in raw.items())


def preset(text: str, base: Parameters = Parameters()) -> Parameters:
    """A flat JSON preset over base: keys that name a parameter count, others are left alone."""
    raw = json.loads(text)
    known = {f.name for f in fields(Parameters)} - {"by_category"}
    return replace(base, **{k: v for k, v in raw.items() if k in known})


@dataclass(frozen=True)
class Rotation:
    """When turned frames are looked at: every frame unless adaptive, else each nth of a streak without a face and some frames after a hit."""

    adaptive: bool = True
    every: int = 1
    after_hit: int = 0
    small_size: int = 0

    def __post_init__(self):
        for name, least in (("every", 1), ("after_hit", 0), ("small_size", 0)):
            object.__setattr__(self, name, max(least, int(getattr(self, name))))

    def turns(self, streak: Column, since_hit: Column, place: Column) -> Column:
        """Whether a frame is looked at turned, from its streak without a face, the frames since the last hit, and its number."""
        if not self.adaptive:
            return F.lit(True)
        return F.coalesce(since_hit <= self.after_hit, F.lit(False)) | ((streak > 0) & (F.pmod(place, F.lit(self.every)) == 0))
