"""Settings from a flat JSON preset, for capture, the lock, the reference bank and the rotation rule."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from ..operators.bank import BankSpec
from ..streaming.lock import LockSpec
from .capture_flow import CaptureSpec
from .parameters import Rotation

#: Names in preset files, with the settings they stand for and their bounds (fixed values; the bounds are ours).
KEYS = {
    "frame_stride": [("capture", "stride", 1, None)],
    "min_det_conf": [("capture", "min_conf", 0.0, 1.0)],
    "face_thresh": [("capture", "face_most", 0.0, 2.0), ("lock", "near", 0.0, 2.0)],
    "reid_thresh": [("capture", "body_most", 0.0, 2.0)],
    "combine": [("capture", "combine", None, None)],
    "min_sharpness": [("capture", "min_sharpness", 0.0, 1.0)],
    "lock_face_thresh": [("lock", "near_locked", 0.0, 2.0)],
    "lock_after_hits": [("lock", "after", 0, None)],
    "lock_face_roi_pad": [("lock", "pad", 0.0, None)],
    "lock_face_roi_max_misses": [("lock", "misses", 0, None)],
    "lock_momentum": [("lock", "momentum", 0.0, 1.0)],
    "iou_gate": [("lock", "gate", 0.0, 1.0)],
    "score_margin": [("lock", "margin", 0.0, 2.0)],
    "min_gap_sec": [("lock", "gap", 0.0, None)],
    "only_best": [("lock", "only_best", None, None)],
    "prescan_fd_add": [("bank", "near", 0.0, 2.0)],
    "prescan_diversity_dedup_cos": [("bank", "apart", -1.0, 1.0)],
    "prescan_add_cooldown_samples": [("bank", "pause", 0, None)],
    "prescan_bank_max": [("bank", "most", 1, None)],
    "prescan_replace_margin": [("bank", "margin", 0.0, None)],
    "prescan_weights": [("bank", "weights", 0.0, None)],
    "rot_adaptive": [("rotation", "adaptive", None, None)],
    "rot_every_n": [("rotation", "every", 1, None)],
    "rot_after_hit_frames": [("rotation", "after_hit", 0, None)],
    "fast_no_face_imgsz": [("rotation", "small_size", 0, None)],
}
COMBINE = ("min", "avg", "face_priority")


@dataclass(frozen=True)
class Settings:
    """ratios are those a crop may have, the first of which is the one of `capture`; others are keys that no setting here answers to."""

    capture: CaptureSpec = CaptureSpec()
    lock: LockSpec = LockSpec()
    bank: BankSpec = BankSpec()
    rotation: Rotation = Rotation()
    ratios: tuple[str, ...] = ("2:3",)
    others: Mapping[str, object] = field(default_factory=dict)


def _within(v: float, low, high):
    v = v if low is None else max(low, v)
    return v if high is None else min(high, v)


def _value(key: str, v, default, low, high):
    """v as the default's type and within bounds; a text or list of another kind than the default's is an error."""
    number = isinstance(v, (int, float)) and not isinstance(v, bool) and v == v
    if isinstance(default, bool):
        right = isinstance(v, bool)
    elif isinstance(default, tuple):
        right = isinstance(v, list) and len(v) == len(default)
    elif isinstance(default, str):
        right = v in COMBINE
    else:
        right = number and (isinstance(default, float) or v == int(v))
    if not right:
        raise ValueError(f"{key} cannot be {v!r}")
    if isinstance(default, tuple):
        return tuple(_value(key, x, d, low, high) for x, d in zip(v, default))
    return v if isinstance(default, (bool, str)) else type(default)(_within(v, low, high))


def _ratios(text) -> tuple[str, ...]:
    found = tuple(r.strip() for r in text.split(",")) if isinstance(text, str) else ()
    for r in found:
        sides = r.split(":")
        if len(sides) != 2 or not all(s.strip().replace(".", "", 1).isdigit() and float(s) > 0 for s in sides):
            raise ValueError(f"ratio cannot be {text!r}")
    if not found:
        raise ValueError(f"ratio cannot be {text!r}")
    return found


def read_preset(text: str, base: Settings = Settings()) -> Settings:
    """Settings of a preset over base. Nulls leave a setting as it is; values beyond the bounds are brought within them."""
    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("a preset is a JSON object")
    parts = {f.name: getattr(base, f.name) for f in fields(Settings)}
    others = dict(base.others)
    for key, v in raw.items():
        if v is None:
            continue
        if key == "ratio":
            parts["ratios"] = _ratios(v)
            parts["capture"] = replace(parts["capture"], ratio=parts["ratios"][0])
        elif key in KEYS:
            for part, name, low, high in KEYS[key]:
                own = parts[part]
                parts[part] = replace(own, **{name: _value(key, v, getattr(type(own)(), name), low, high)})
        else:
            others[key] = v
    return Settings(**{**parts, "others": others})
