import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import align, regions
from reelspark.plans import catalogue


def by_flood(gray):
    """Components of the pixels up to each tone, as sets; one for each tone at which it has grown."""
    h, w = gray.shape
    levels = []
    for tone in range(256):
        left, own = {(y, x) for y in range(h) for x in range(w) if gray[y, x] <= tone}, []
        while left:
            todo = [left.pop()]
            found = set(todo)
            while todo:
                y, x = todo.pop()
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if n in left:
                        left.remove(n)
                        found.add(n)
                        todo.append(n)
            own.append(frozenset(found))
        levels.append(own)
    return levels


def stable_by_sets(gray, delta, least, most, change, apart):
    levels = by_flood(gray)
    born = {}
    for tone, own in enumerate(levels):
        for c in own:
            born.setdefault(c, tone)
    inside = [{pixel: c for c in own for pixel in c} for own in levels]
    at = {c: next(iter(c)) for c in born}
    growth = {c: (len(inside[min(255, t + delta)][at[c]]) - len(c)) / len(c) for c, t in born.items()}
    growth[frozenset(np.ndindex(gray.shape))] = np.inf
    parent = {c: next((inside[t][at[c]] for t in range(born[c], 256) if inside[t][at[c]] != c), None) for c in born}
    children = {}
    for c, d in parent.items():
        children.setdefault(d, []).append(c)
    good = {c for c in born if growth[c] < change and least <= len(c) <= most and (parent[c] is None or growth[c] <= growth[parent[c]]) and all(growth[c] < growth[d] for d in children.get(c, ()))}
    kept = set()
    for c in good:
        around = min((d for d in good if c < d), key=len, default=None)
        if around is None or len(around) - len(c) >= apart * len(around):
            kept.add(c)
    return sorted((born[c], len(c), min(x for _, x in c), min(y for y, _ in c), max(x for _, x in c), max(y for y, _ in c)) for c in kept)


@pytest.mark.parametrize("seed", range(12))
def test_stable_regions_equal_flood_fill(seed):
    rng = np.random.default_rng(seed)
    gray = (rng.integers(0, 6, (7, 9)) * rng.integers(1, 40)).astype(np.uint8)
    limits = dict(delta=int(rng.integers(1, 40)), least=int(rng.integers(1, 4)), most=int(rng.integers(10, 70)), change=float(rng.choice([0.3, 1.0, 5.0])), apart=float(rng.choice([0.0, 0.2, 0.6])))
    tree = regions.component_tree(gray)
    got = sorted(tuple(int(tree[c][i]) for c in ("tone", "area", "x1", "y1", "x2", "y2")) for i in regions.stable(tree, **limits))
    assert got == stable_by_sets(gray, **limits)


def test_corner_text_is_found(spark):
    page = np.full((120, 200), 90, np.uint8)
    for k in range(3):
        page[3 : 13, 4 + 30 * k : 26 + 30 * k] = 230  # only the first touches the corner of 26 x 26
    page[60:75, 90:120] = 10
    rows = [(1, bytearray(page.tobytes()), 200, 120), (2, bytearray(b"\x05" * 400), 20, 20), (3, None, 20, 20), (4, bytearray(b"x"), 20, 20), (5, bytearray(b""), 0, 0)]
    found = regions.stable_regions(spark.createDataFrame(rows, "id long, pixels binary, w int, h int"), ["id"])
    got = {r.id: r for r in found.select("*", regions.corner_score(F.col("regions"), F.col("w"), F.col("h")).alias("score")).collect()}
    assert sorted((r.x, r.y, r.w, r.h, r.area, r.dark) for r in got[1].regions) == [(4, 3, 22, 10, 220, False), (34, 3, 22, 10, 220, False), (64, 3, 22, 10, 220, False), (90, 60, 30, 15, 450, True)]
    assert got[1].score == 1 / 25 and got[2].regions == [] and [got[k].regions for k in (3, 4, 5)] == [None] * 3
    assert [got[k].score for k in (3, 4, 5)] == [0.0] * 3


@pytest.mark.parametrize("outlier", [None, 0, 2, 4])
def test_planted_similarity_is_recovered(outlier):
    rng = np.random.default_rng(outlier or 9)
    goal = np.array(align.TEMPLATE)
    for _ in range(20):
        turn, scale, shift = rng.random() * 6, 0.3 + rng.random() * 3, rng.random(2) * 100
        m = scale * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        points = (goal - shift) @ np.linalg.inv(m).T
        if outlier is not None:
            points[outlier] += rng.random(2) * 50 + 20
        assert np.allclose(align.similarity(points, goal), np.column_stack([m, shift]), atol=1e-6)
    assert align.similarity(np.ones((5, 2)), goal) is None


def test_chip_equals_loops_and_edge_rows(spark):
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    points = np.array(align.TEMPLATE) * 0.3 @ np.array([[0.9, 0.2], [-0.2, 0.9]]) + 3 + rng.random((5, 2))
    m = align.similarity(points, np.array(align.TEMPLATE))
    want = np.zeros((112, 112, 3))
    mirror = lambda i, n: [*range(n), *range(n - 1, -1, -1)][i % (2 * n)]
    for v in range(112):
        for u in range(112):
            x, y = np.linalg.solve(m[:, :2], np.array([u, v]) - m[:, 2])
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            for dx, wx in ((0, 1 - (x - x0)), (1, x - x0)):
                for dy, wy in ((0, 1 - (y - y0)), (1, y - y0)):
                    want[v, u] += wx * wy * picture[mirror(y0 + dy, 30), mirror(x0 + dx, 40)].astype(float)
    raw, flat = bytearray(picture.tobytes()), [float(p) for p in points.ravel()]
    rows = [(1, raw, 40, 30, flat), (2, raw, 40, 30, None), (3, raw, 40, 30, [1.0] * 10), (4, raw, 40, 30, flat[:9] + [None]), (5, None, 40, 30, flat), (6, raw[:5], 40, 30, flat)]
    got = {r.id: r for r in align.aligned(spark.createDataFrame(rows, "id long, pixels binary, w int, h int, points array<double>"), ["id"]).collect()}
    own = np.frombuffer(bytes(got[1].pixels), np.uint8).reshape(112, 112, 3)
    assert np.abs(own - want).max() <= 0.5 + 1e-6
    assert got[2].pixels == got[3].pixels == got[4].pixels and len(got[2].pixels) == 112 * 112 * 3
    assert got[5].pixels is None and got[6].pixels is None and got[6].w is None
    assert (align.chip(np.full((300, 200, 1), 7, np.uint8), None) == 7).all()


def test_queries_of_pictures(spark):
    sf_dir = "/root/testdata/sf0.001"
    vecs = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 60").collect()}
    found = {r.id: r for r in catalogue.queries()["picture_regions"](spark, sf_dir).collect()}
    assert set(found) >= set(vecs)
    got = {i: found[i] for i in (0, 1)}
    limits = dict(delta=5, least=4, most=5000, change=0.25, apart=0.2)
    for i, r in got.items():
        gray = np.frombuffer(bytes(r.pixels), np.uint8).reshape(32, 32)
        want = [(x, y, u - x + 1, v - y + 1) for picture in (gray, 255 - gray) for _, _, x, y, u, v in stable_by_sets(picture, **limits)]
        side = int(0.22 * 32)
        marks = sum((x < side or x + w > 32 - side) and (y < side or y + h > 32 - side) and 1.5 <= w / (h + 1e-6) <= 12 and w * h >= 80 for x, y, w, h in want)
        assert r.regions == len(want) and r.score == min(1.0, marks / 25)
    chips = catalogue.queries()["face_chips"](spark, sf_dir).collect()
    assert len(chips) == len(found) and {len(r.pixels) for r in chips} == {112 * 112}


@pytest.mark.parametrize("at_once", [1, 700, 1 << 18])
def test_pictures_looked_at_together_equal_each_alone(spark, at_once):
    """Sizes differ, one picture is missing; their trees grow side by side without a pixel of one joining another's."""
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 6, size).astype(np.uint8) * 40 for size in ((9, 14), (1, 1), (1, 12), (13, 1), (20, 20), (6, 7))]
    alone = [regions.regions(p, least=2) for p in pictures]
    assert regions.regions_of_all(pictures, least=2) == alone and regions.regions_of_all([], least=2) == []
    rows = [(i, p.tobytes(), p.shape[1], p.shape[0]) for i, p in enumerate(pictures)]
    frame = spark.createDataFrame([*rows, (6, None, 3, 3)], "id long, pixels binary, w int, h int").coalesce(1)
    got = {r.id: r.regions and [tuple(x) for x in r.regions] for r in regions.stable_regions(frame, ["id"], pixels_at_once=at_once, least=2).collect()}
    assert got == {**{i: [tuple(x.values()) for x in found] for i, found in enumerate(alone)}, 6: None}
