"""Capture end to end against a loop over frames, and the settings of presets."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import images
from reelspark.operators.bank import BankSpec
from reelspark.plans import catalogue
from reelspark.plans.capture_flow import CaptureSpec, cropped, hit_index, matches
from reelspark.plans.presets import Settings, read_preset
from reelspark.streaming.lock import LockSpec

RNG = np.random.default_rng(31)
FRAME, PERSON, FACE = "video_id long, frame_idx long, w int, h int, pixels binary", "video_id long, frame_idx long, person long, x1 double, y1 double, x2 double, y2 double, conf double, body array<double>", "video_id long, frame_idx long, person long, face long, x1 double, y1 double, x2 double, y2 double, vec array<double>"


def made_up():
    vector = lambda: None if RNG.random() < 0.2 else [float(x) for x in RNG.normal(size=4)]
    frames = [(v, n, 90 + 10 * v, 60, RNG.integers(0, 256, (90 + 10 * v) * 60, dtype=np.uint8).tobytes()) for v in range(2) for n in range(20)]
    persons, faces = [], []
    for v, n, w, h, _ in frames:
        for p in range(int(RNG.integers(2, 9))):
            x, y = RNG.uniform(-8, w - 6), RNG.uniform(-8, h - 6)
            persons.append((v, n, p, float(x), float(y), float(x + RNG.uniform(1, 60)), float(y + RNG.uniform(1, 60)), None if RNG.random() < 0.05 else float(RNG.random()), vector()))
            for f in range(int(RNG.integers(0, 3))):
                a, b = RNG.integers(0, 20, 2)
                faces.append((v, n, p, f, float(a), float(b), float(a + RNG.integers(2, 20)), float(b + RNG.integers(2, 20)), vector()))
    return frames, persons, faces


def hits_by_loops(frames, persons, faces, face_ref, body_ref, spec):
    """Accepted persons with their distances; the crops are held by the SQL of capture_flow."""
    apart = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))
    sizes, want = {(v, n): (w, h) for v, n, w, h, _ in frames if n % spec.stride == 0}, {}
    for v, n, p, x1, y1, x2, y2, conf, body in persons:
        if (v, n) not in sizes or conf is None or conf < spec.min_conf:
            continue
        w, h = sizes[v, n]
        x1, y1, x2, y2 = max(0, int(x1)), max(0, int(y1)), min(w - 1, int(x2)), min(h - 1, int(y2))
        if x2 <= x1 + 2 or y2 <= y1 + 2:
            continue
        near = [apart(f[-1], face_ref) for f in faces if f[:3] == (v, n, p) and f[-1] is not None] if face_ref else []
        fd, rd = min(near, default=None), apart(body, body_ref) if body and body_ref else None
        if (fd is not None and fd <= spec.face_most) or (rd is not None and rd <= spec.body_most):
            want[v, n, p] = (fd, rd, min(d for d in (fd, rd) if d is not None))
    return want


@pytest.mark.parametrize("face_ref,body_ref", [([1.0, 0.5, 0.0, -1.0], [0.0, 1.0, 1.0, 0.0]), (None, [0.0, 1.0, 1.0, 0.0]), ([1.0, 0.5, 0.0, -1.0], None), (None, None)])
def test_matches_equal_a_loop_over_frames(spark, face_ref, body_ref):
    rows = made_up()
    frames, persons, faces = (spark.createDataFrame(r, s) for r, s in zip(rows, (FRAME, PERSON, FACE)))
    spec = CaptureSpec(face_most=0.9, body_most=0.8)
    found = matches(frames, persons, faces, face_ref, body_ref, spec).collect()
    want = hits_by_loops(*rows, face_ref, body_ref, spec)
    assert sorted((r.video_id, r.frame_idx, r.person) for r in found) == sorted(want)
    for r in found:
        assert np.allclose([x if x is not None else -1 for x in (r.fd, r.rd, r.score)], [x if x is not None else -1 for x in want[r.video_id, r.frame_idx, r.person]])
        assert 0 <= r.x1 <= r.x2 <= r.w and 0 <= r.y1 <= r.y2 <= r.h
    assert not (face_ref or body_ref) or len(found) > 5


def test_crops_and_their_gate(spark):
    rows = made_up()
    frames, persons, faces = (spark.createDataFrame(r, s) for r, s in zip(rows, (FRAME, PERSON, FACE)))
    spec = CaptureSpec(face_most=1.2, body_most=1.2, min_sharpness=0.97)
    found = matches(frames, persons, faces, [1.0, 0.5, 0.0, -1.0], [0.0, 1.0, 1.0, 0.0], spec)
    held, pictures = found.collect(), {(v, n): np.frombuffer(p, np.uint8).reshape(h, w) for v, n, w, h, p in rows[0]}
    want = {}
    for r in held:
        part = pictures[r.video_id, r.frame_idx][r.y1 : r.y2, r.x1 : r.x2]
        want[r.video_id, r.frame_idx, r.person] = (part.tobytes() if part.size else None, images.sharpness(part) if part.size else 0.0)
    every = {(r.video_id, r.frame_idx, r.person): r for r in cropped(found, frames).collect()}
    assert {k: (r.pixels and bytes(r.pixels), r.sharpness) for k, r in every.items()} == want
    middle = float(np.median([s for _, s in want.values()]))
    gated = cropped(found, frames, CaptureSpec(min_sharpness=middle)).collect()
    assert {(r.video_id, r.frame_idx, r.person) for r in gated} == {k for k, (_, s) in want.items() if s >= middle} and 0 < len(gated) < len(want)
    named = {r.person: r for r in hit_index(found.where("video_id = 0 AND frame_idx = %d" % min(r.frame_idx for r in held if r.video_id == 0))).collect()}
    assert {r.crop_path for r in named.values()} == {f"f{next(iter(named.values())).frame:08d}.jpg"}


def test_empty_and_null_rows(spark):
    frames = spark.createDataFrame([(1, 0, 50, 40, None), (None, 2, 50, 40, None), (1, 2, None, 40, None)], FRAME)
    persons = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 20.0, 30.0, 0.9, [1.0]), (1, 0, 2, None, 0.0, 20.0, 30.0, 0.9, [1.0]), (None, 2, 1, 0.0, 0.0, 20.0, 30.0, 0.9, [1.0]), (1, 2, 1, 0.0, 0.0, 20.0, 30.0, 0.9, [1.0]), (1, 0, 3, 0.0, 0.0, 20.0, 30.0, 0.9, [0.0])], PERSON)
    faces = spark.createDataFrame([], FACE)
    found = matches(frames, persons, faces, [1.0], [1.0])
    assert [(r.person, r.fd, r.rd) for r in found.where("person = 1").collect()] == [(1, None, 0.0)]
    assert [r.person for r in found.collect()] == [1] and matches(frames.where("false"), persons, faces, [1.0], [1.0]).count() == 0
    assert [(r.pixels, r.sharpness) for r in cropped(found.where("person = 1"), frames).collect()] == [(None, 0.0)]


def test_query_has_faces_and_bodies(spark):
    got = catalogue.queries()["capture_flow"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and (got.face_dist != "").any() and (got.reid_dist != "").any() and (got.face_dist == "").any()


def test_preset():
    given = {"ratio": "3:2, 1:1", "frame_stride": 0, "face_thresh": 0.4, "combine": "avg", "only_best": False, "lock_momentum": 3, "prescan_weights": [1, 0, -2], "prescan_bank_max": 9, "rot_every_n": 12, "rot_adaptive": None, "yolo_model": "x.pt"}
    got = read_preset(json.dumps(given))
    assert got.capture == CaptureSpec(ratio="3:2", stride=1, face_most=0.4, combine="avg") and got.ratios == ("3:2", "1:1")
    assert got.lock == LockSpec(near=0.4, momentum=1.0, only_best=False) and got.bank == BankSpec(most=9, weights=(1.0, 0.0, 0.0))
    assert got.rotation.every == 12 and got.rotation.adaptive and got.others == {"yolo_model": "x.pt"}
    assert read_preset("{}") == Settings() and read_preset('{"iou_gate": 0.2}', got).lock.near == 0.4
    for wrong in ({"face_thresh": "0.4"}, {"only_best": 1}, {"frame_stride": 1.5}, {"combine": "max"}, {"prescan_weights": [1, 2]}, {"prescan_weights": [1, 2, "x"]}, {"ratio": "2/3"}, {"ratio": 5}, {"ratio": "0:1"}, {"lock_momentum": True}, {"face_thresh": float("nan")}):
        with pytest.raises(ValueError, match="cannot be"):
            read_preset(json.dumps(wrong))
    with pytest.raises(ValueError, match="object"):
        read_preset("[]")
