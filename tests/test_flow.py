"""Curation end to end, scenes and parameters against loops written from their definitions."""

import math

import numpy as np
import pytest

from reelspark.operators import greedy, scenes, selection
from reelspark.plans import catalogue, flow
from reelspark.plans.bridge import view
from reelspark.plans.parameters import Parameters, preset, quotas, resolve

SF = "/root/testdata/sf0.001"
SMALL = (("portrait", 10, 30), ("closeup", 8, 25), ("cowboy", 8, 20), ("full", 5, 20), ("wide", 5, 15), ("profile", 0, 9))
GIVEN = Parameters(scene_similarity=0.3, most_bits=12, scene_bits=16)


def near(a, b, most):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= most


def cosine(a, b):
    return float(a @ b) / ((np.linalg.norm(a) + 1e-6) * (np.linalg.norm(b) + 1e-6))


def loops_scenes(items, similarity, bits, gap, window):
    """items: dicts in any order; gives each item's scene."""
    alike = lambda x, y: near(x["hash"], y["hash"], bits) or (x["clip"] is not None and y["clip"] is not None and cosine(x["clip"], y["clip"]) >= similarity)
    clusters = []
    for x in sorted(items, key=lambda x: (x["ts"], x["path"])):
        for c in list(reversed(clusters))[: max(1, window)]:
            if alike(x, c["medoid"]):
                c["own"].append(x)
                if x["q"] > c["medoid"]["q"]:
                    c["medoid"] = x
                break
        else:
            clusters.append({"own": [x], "medoid": x})
    merged = []
    for c in clusters:
        if window > 0 and merged and abs(c["own"][0]["ts"] - merged[-1][-1]["ts"]) <= gap and alike(c["own"][0], merged[-1][-1]):
            merged[-1] += c["own"]
        else:
            merged.append(list(c["own"]))
    return {x["id"]: k for k, own in enumerate(merged) for x in own}


def loops_selection(scenes, given):
    """scenes: by number, items in order with q, category, is_profile, hash, vec."""
    waiting = {s: list(own) for s, own in sorted(scenes.items())}
    caps, counts, per_scene, log, picked = {c: m for c, _, m in given.by_category}, {}, {}, [], []
    limit = min(given.most, sum(map(len, waiting.values())))

    def barred(x):
        return any(near(x["hash"], p["hash"], given.most_bits) for p in picked) or x["is_profile"] and counts.get("profile", 0) >= caps.get("profile", given.most)

    def offer(wanted, penalty):
        offers = []
        for s, own in waiting.items():
            for x in [x for x in own if wanted(x)]:
                if barred(x):
                    own.remove(x)
                    continue
                base = [p["vec"] for p in picked if p["vec"] is not None]
                again = 0.0 if not base else given.no_vector if x["vec"] is None else max([0.0, *(float(x["vec"] @ v) for v in base)])
                offers.append((given.alpha * x["q"] - (1 - given.alpha) * again - penalty(s), s, x, again))
                break
        if not offers:
            return False
        score, s, x, again = max(offers, key=lambda o: o[0])
        waiting[s].remove(x)
        picked.append(x)
        counts[x["category"]] = counts.get(x["category"], 0) + 1
        if x["is_profile"]:
            counts["profile"] = counts.get("profile", 0) + 1
        per_scene[s] = per_scene.get(s, 0) + 1
        log.append((len(log) + 1, x["id"], x["path"], s, x["category"], x["is_profile"], x["q"], again, score))
        return True

    for category, least, _ in given.by_category:
        for _ in range(0 if category == "profile" else min(least, limit - len(log))):
            if not offer(lambda x: x["category"] == category, lambda s: 0.0):
                break
    full = lambda x: counts.get(x["category"], 0) >= caps.get(x["category"], given.most)
    while len(log) < limit and offer(lambda x: not full(x), lambda s: given.soft_penalty if 0 < given.soft_cap <= per_scene.get(s, 0) else 0.0):
        pass
    return log


def ratio(w, h):
    r = w / h
    return "2:3" if 0.6 <= r <= 0.7 else "3:4" if 0.7 < r <= 0.82 else "1:1" if 0.95 <= r <= 1.05 else "3:2" if 1.4 <= r <= 1.7 else "narrow" if r < 0.6 else "wide" if r > 1.7 else "other"


def category(r, face):
    if r in ("2:3", "3:4"):
        return "closeup" if face >= 0.33 else "portrait" if face >= 0.22 else "cowboy" if face >= 0.12 else "full"
    if r in ("3:2", "wide"):
        return "closeup" if face >= 0.3 else "wide"
    return "closeup" if r == "1:1" and face >= 0.3 else "portrait"


def mixed(clip, feat, a, b):
    parts = [(v / (np.linalg.norm(v) + 1e-6)) * w for v, w in ((clip, a), (feat, b)) if v is not None]
    if not parts:
        return None
    size = max(map(len, parts))
    total = sum(np.pad(p, (0, size - len(p))) for p in parts)
    return total / (np.linalg.norm(total) + 1e-6)


@pytest.mark.parametrize("given", [GIVEN, Parameters(scene_similarity=0.3, most_bits=12, scene_bits=16, soft_cap=2, soft_penalty=0.15, most=90, by_category=SMALL), Parameters(scene_aware=False, most_bits=16), Parameters(scene_similarity=0.3, ground_weight=0.0, face_weight=0.0)])
def test_curation_equals_loops(spark, given):
    frame = flow.candidates(view(spark, SF, "v_vec"))
    items = []
    for r in frame.collect():
        if r.face_fd <= given.fd_max and r.sharpness >= given.sharp_min:
            unit = lambda x: min(1.0, max(0.0, x))
            q = 0.45 * unit(1 - max(0.0, r.face_fd) / 0.5) + 0.3 * r.sharpness + 0.2 * r.exposure + 0.05 * min(1.0, r.face_quality / 1200)
            q = unit(q * max(0.0, 1 - 0.6 * r.wmark) * max(0.0, 1 - 0.6 * min(0.4, r.border)))
            clip, feat = (None if v is None else np.array(v, float) for v in (r.clip, r.feat))
            items.append({**r.asDict(), "q": q, "clip": clip, "vec": mixed(clip, feat, given.ground_weight, given.face_weight), "category": category(ratio(r.w, r.h), r.face_frac), "is_profile": abs(r.yaw) >= 50})
    scene = loops_scenes(items, given.scene_similarity, given.most_bits, given.scene_gap, given.scene_window) if given.scene_aware else dict.fromkeys((x["id"] for x in items), -1)
    members, bits = {}, given.scene_bits if given.scene_aware else given.most_bits
    for x in sorted(items, key=lambda x: (-x["q"], x["face_fd"], x["ts"], x["path"])):
        own = members.setdefault(scene[x["id"]], [])
        if not any(near(x["hash"], y["hash"], bits) for y in own):
            own.append(x)
    for s, own in members.items():
        for x in own:
            x["q"] = min(1.5, x["q"] * (1 + 0.25 * min(1.0, max(0.0, x["face_frac"] - 0.33) / (1 - 0.33))))
        left, order = list(own), []
        while left:
            worth = [given.alpha * x["q"] - (1 - given.alpha) * max([0.0, *(float(x["vec"] @ y["vec"]) for y in order if x["vec"] is not None and y["vec"] is not None)]) for x in left]
            order.append(left.pop(int(np.argmax(worth))))
        members[s] = order
    want = loops_selection(members, given)
    got = sorted((r.rank, r.id, r.path, r.scene, r.category, r.is_profile, r.quality, r.redundancy, r.score) for r in flow.curated(frame, given).collect())
    assert len(want) > 50 and len({w[4] for w in want}) > 3 and [g[:6] for g in got] == [w[:6] for w in want]
    assert all(math.isclose(a, b, abs_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[6:], w[6:]))


def test_scene_queries_equal_loops(spark):
    got = {(r.pool, r.id): r.scene for r in catalogue.queries()["scene_cluster"](spark, SF).collect()}
    vecs = view(spark, SF, "v_vec").collect()
    hashed = {r.id: sum(1 << i for i in range(63) if r.embedding[i] > 0) for r in vecs}
    sizes = {}
    for pool in {r.scene_hint for r in vecs}:
        items = [{"id": r.id, "ts": r.ts, "path": str(r.id), "hash": hashed[r.id], "clip": np.array(r.embedding, float), "q": r.q} for r in vecs if r.scene_hint == pool]
        want = loops_scenes(items, 0.3, 20, 4.0, 64)
        assert {i: got[pool, i] for i in want} == want
        sizes[pool] = np.bincount(list(want.values()))
    for r in catalogue.queries()["scene_stats"](spark, SF).collect():
        assert (r.scenes, r.p50, r.p95, r.largest) == pytest.approx((len(sizes[r.pool]), np.percentile(sizes[r.pool], 50), np.percentile(sizes[r.pool], 95), sizes[r.pool].max()))


@pytest.mark.parametrize("block_rows,window,pools", [(20, 3, 1), (60, 64, 1), (24, 0, 3), (1_000_000, 5, 2)])
def test_scenes_in_blocks_equal_loops(spark, block_rows, window, pools):
    """Blocks far smaller than a scene, and pools of few scenes, whose state goes on through all blocks."""
    rng = np.random.default_rng(block_rows)
    items = []
    for k in range(400):
        kind = (k // 37) % 6 if pools == 1 else int(rng.integers(40))
        h = (kind * 0x9E3779B97F4A7C15) % 2**64
        for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            h ^= 1 << int(bit)
        clip = None if k % 7 == 0 else [float(x) for x in rng.normal(0, 0.4, 8) + (np.arange(8) == kind % 8) * 3]
        items.append({"pool": None if k % pools == 2 else k % pools, "id": k, "ts": float(rng.integers(0, 150)), "path": f"p{k % 50:03d}", "hash": h, "clip": clip, "q": float(rng.integers(0, 10)) / 10})
    rows = [(x["pool"], x["id"], x["ts"], x["path"], x["hash"] - 2**64 if x["hash"] >= 2**63 else x["hash"], x["clip"], x["q"]) for x in items]
    frame = spark.createDataFrame(rows, "pool int, id long, ts double, path string, hash long, clip array<double>, q double")
    got = {r.id: r.scene for r in scenes.cluster_scenes(frame, "pool", 0.9, 7, 4.0, window, block_rows).collect()}
    want = {}
    for pool in {x["pool"] for x in items}:
        own = [x | {"clip": None if x["clip"] is None else np.array(x["clip"]), "path": (x["path"], x["id"])} for x in items if x["pool"] == pool]
        want |= loops_scenes(own, 0.9, 7, 4.0, window)
    assert got == want
    sizes = scenes.in_blocks(frame, ["pool", "ts", "path", "id"], block_rows).groupBy("block").count().collect()
    assert max(r["count"] for r in sizes) <= block_rows and len(sizes) >= min(400 / block_rows, 2)
    assert scenes.cluster_scenes(frame.where("false"), "pool").count() == 0


@pytest.mark.parametrize("scenes_given,depth,given", [
    (1, 1, Parameters(most=8, by_category=(("portrait", 2, 4), ("closeup", 1, 4), ("profile", 0, 2), ("wide", 1, 9)))),
    (2, 2, Parameters(most=40, soft_cap=1, soft_penalty=0.2, by_category=(("wide", 4, 6), ("portrait", 0, 50), ("closeup", 9, 12), ("profile", 0, 2)))),
    (128, 16, Parameters(most=500)),
])
def test_selection_by_heads_equals_loops(spark, scenes_given, depth, given):
    """One pool of many scenes with a very large one; heads so small that most rounds end for want of a bound."""
    rng = np.random.default_rng(depth)
    rows, found = [], {}
    for k in range(300):
        pool = [None, 1, 2][int(rng.choice(3, p=[0.1, 0.2, 0.7]))]
        scene = 5 if rng.random() < 0.4 else int(rng.integers(0, 30))
        own = found.setdefault(pool, {}).setdefault(scene, [])
        h = int(rng.integers(0, 40)) * 0x9E3779B97F4A7C15 % 2**64 ^ (1 << int(rng.integers(64)))
        vec = None if rng.random() < 0.2 else [float(x) for x in rng.integers(-2, 3, 6) / 4]
        x = {"id": k, "path": "", "q": float(rng.integers(0, 30)) / 30, "category": ["portrait", "closeup", "wide", "odd"][int(rng.integers(4))], "is_profile": bool(rng.random() < 0.3), "hash": h, "vec": vec}
        rows.append((pool, k, scene, len(own), x["category"], x["is_profile"], x["q"], h - 2**64 if h >= 2**63 else h, vec))
        own.append(x | {"vec": None if vec is None else np.array(vec)})
    frame = spark.createDataFrame(rows, "pool int, id long, scene int, place int, category string, is_profile boolean, q double, hash long, vec array<double>")
    got = {}
    for r in selection.select_by_quota(frame, "pool", given.quotas(), 25, scenes_given, depth).collect():
        got.setdefault(r.pool, []).append((r["rank"], r.id, r.scene, r.category, r.quality, r.redundancy, r.score))
    for pool, own in found.items():
        want = [(w[0], w[1], w[3], w[4], *w[6:]) for w in loops_selection(own, given)]
        assert [g[:4] for g in sorted(got[pool])] == [w[:4] for w in want]
        assert all(math.isclose(a, b, abs_tol=1e-9) for g, w in zip(sorted(got[pool]), want) for a, b in zip(g[4:], w[4:]))
    assert selection.select_by_quota(frame.where("false"), "pool").count() == 0


@pytest.mark.parametrize("most", [3, 7, 18])
def test_near_hashes_everywhere_equal_loops(spark, most):
    rng = np.random.default_rng(most)
    base = [int(x) for x in rng.integers(0, 2**64, 12, dtype=np.uint64)]
    rows = []
    for i in range(300):
        h = base[i % 12]
        for bit in rng.choice(64, int(rng.integers(0, 12)), replace=False):
            h ^= 1 << int(bit)
        rows.append((float(rng.integers(5)), i, h - 2**64 if h >= 2**63 else h))
    kept = []
    for row in sorted(rows):
        if not any(near(row[2], k[2], most) for k in kept):
            kept.append(row)
    frame = spark.createDataFrame(rows, "`order` double, id long, hash long")
    assert sorted(map(tuple, greedy.drop_near_hashes_everywhere(frame, ["order", "id"], "hash", most).collect())) == kept
    assert greedy.drop_near_hashes_everywhere(frame.where("false"), ["order", "id"], "hash", most).count() == 0


def test_near_hashes_of_a_dense_cluster(spark):
    """3000 different hashes around one: all but the first go, without a pair for each two of them; groups by themselves."""
    rng = np.random.default_rng(1)
    rows = [(k % 2, k, sum(1 << int(b) for b in rng.choice(63, 3, replace=False))) for k in range(3000)]
    frame = spark.createDataFrame(rows, "pool int, id long, hash long")
    assert sorted(tuple(r) for r in greedy.drop_near_hashes_everywhere(frame, ["id"], "hash", 7, ["pool"]).collect()) == sorted([(0, 0, rows[0][2]), (1, 1, rows[1][2])])


@pytest.mark.parametrize("most,by_lookups", [(3, True), (3, False), (16, None)])
def test_near_hashes_by_lookups_and_by_blocks_equal_loops(spark, most, by_lookups):
    """Hashes of 16 scattered bits, negative ones among them, in groups and blocks of 30 rows; a wide threshold must not make a lookup of each row thousandfold."""
    rng = np.random.default_rng(most)
    spread = sum(1 << (4 * i + 3) for i in range(16))
    wide = spread if most == 3 else 2**64 - 1
    rows = [(None if k % 4 == 0 else k % 2, k, int(rng.integers(0, 2**64, dtype=np.uint64)) & wide) for k in range(260)]
    rows = [(p, k, h - 2**64 if h >= 2**63 else h) for p, k, h in rows]
    want = []
    for pool in (None, 0, 1):
        kept = []
        for row in rows:
            if row[0] == pool and not any(near(row[2], k[2], most) for k in kept):
                kept.append(row)
        want += kept
    frame = spark.createDataFrame(rows, "pool int, id long, hash long")
    got = greedy.drop_near_hashes_everywhere(frame, ["id"], "hash", most, ["pool"], 30, by_lookups).select("pool", "id", "hash").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert greedy._lookup(50_000, 16, list(range(63)))[2] * 200 > 50_000  # so blocks are taken


def test_near_hashes_of_sixteen_bits_are_not_looked_up(spark):
    """Hashes of dedup_global: a row looked up by segments moves as hundreds of rows, and tasks hold them."""
    rng = np.random.default_rng(5)
    rows = [(k, sum(int(b) << (4 * i) for i, b in enumerate(rng.integers(0, 2, 16)))) for k in range(3000)]
    kept = []
    for row in rows:
        if not any(near(row[1], k[1], 3) for k in kept):
            kept.append(row)
    sc = spark.sparkContext

    def moved() -> dict[int, int]:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}

    frame = spark.createDataFrame(rows, "id long, hash long")
    before = moved()
    assert sorted(map(tuple, greedy.drop_near_hashes_everywhere(frame, ["id"], "hash", 3).collect())) == kept
    assert sum(n for stage, n in moved().items() if stage not in before) < 10 * len(rows)


def test_lookups_of_a_row_do_not_grow_with_the_rows():
    """Six times the rows of 1 GB: 64 lookups a row as before, not 696, all of which are shuffled and held in memory."""
    tried = lambda n: sum(map(len, greedy._lookup(n, 7, list(range(63)))[1]))
    assert tried(600_000) == tried(100_000) == 64


def test_rounds_of_a_long_chain_are_joined_at_once(spark):
    """Each of 39 rows is near the one before and after it: every second one stays, after ten rounds and by one join."""
    rows = [(k, (1 << 3 * k) - 1) for k in range(20)]
    rows += [(20 + k, (1 << 60) - (1 << 3 * k)) for k in range(1, 20)]
    kept = []
    for row in rows:
        if not any(near(row[1], k[1], 5) for k in kept):
            kept.append(row)
    found = greedy.drop_near_hashes_everywhere(spark.createDataFrame(rows, "id long, hash long"), ["id"], "hash", 5, by_lookups=True)
    assert sorted(map(tuple, found.collect())) == kept
    assert 15 < len(kept) < 25
    assert found._jdf.queryExecution().analyzed().toString().count("Join LeftAnti") == 1


@pytest.mark.parametrize("most", [25, 60])
def test_curation_of_large_scenes_reads_the_order_as_far_as_it_must(spark, most):
    """Of 60 picks some depend on all of the order; the picks are those of the whole one."""
    items = flow.candidates(view(spark, "/root/testdata/sf0.01", "v_vec").where("id < 260"))
    given = Parameters(scene_aware=False, most_bits=16, most=most)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select("pool", "rank", "id", "scene", "category", "quality", "redundancy", "score").collect())
    assert rows(flow.curated(items, given, block_rows=50, first=1)) == rows(flow.curated(items, given))


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_near_hashes_of_large_groups_equal_loops(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [(None if k % 3 == 0 else int(k % 3 == 1 or rng.random() < 0.1), k, int(rng.integers(0, 2**12)) << 40) for k in range(120)]
    want = []
    for pool in (None, 0, 1):
        kept = []
        for row in rows:
            if row[0] == pool and not any(near(row[2], k[2], 2) for k in kept):
                kept.append(row)
        want += kept
    frame = spark.createDataFrame(rows, "pool int, id long, hash long")
    got = greedy.drop_near_hashes_of_any(frame, ["pool"], ["id"], "hash", 2, block_rows).select("pool", "id", "hash").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("block_rows,head", [(30, 7), (90, 64), (100_000, 1)])
def test_diverse_permutation_of_large_groups_equals_loops(spark, block_rows, head):
    """Few values, so that many rows are worth the same."""
    rng = np.random.default_rng(head)
    rows = [(None if k < 20 else k % 2, k, k * 7 % 260, float(rng.integers(0, 6)) / 6, None if k % 11 == 0 else [float(x) for x in rng.integers(-2, 3, 4) / 4]) for k in range(260)]
    frame = spark.createDataFrame(rows, "pool int, id long, `order` long, q double, vec array<double>")
    got = {}
    for r in greedy.diverse_permutation(frame, ["pool"], 0.75, block_rows, head).collect():
        got.setdefault(r.pool, {})[r["rank"]] = r.id
    for pool in (None, 0, 1):
        left, order = [x for x in sorted(rows, key=lambda x: x[2]) if x[0] == pool], []
        while left:
            dots = lambda x: [sum(a * b for a, b in zip(x[4], y[4])) for y in order if x[4] and y[4]]  # noqa: B023, E731
            order.append(left.pop(int(np.argmax([0.75 * x[3] - 0.25 * max([0.0, *dots(x)]) for x in left]))))
        assert [got[pool][k] for k in range(len(order))] == [x[1] for x in order]


def test_parameters():
    found = resolve({"alpha": 3.0, "most": 50}, {"PC_MMR_ALPHA": "0.1", "PC_SCENE_NN_WINDOW": "-4", "PC_FD_MAX": "x", "PC_SCENE_AWARE": "No", "PC_SCENE_SOFT_PENALTY": " ", "PC_SCENE_SOFT_BONUS": "0.2", "PC_SCENE_SIM": "-1", "PC_DEDUP_HAMM": "6.9"})
    assert (found.alpha, found.most, found.scene_window, found.fd_max, found.scene_aware, found.soft_penalty, found.scene_similarity, found.most_bits) == (1.0, 50, 0, 0.45, False, 0.2, -1.0, 6)
    assert resolve() == Parameters()
    assert quotas('{"wide": [1, 2], "full": [0, 3]}') == (("wide", 1, 2), ("full", 0, 3))
    for bad in ("[1]", '{"wide": [1]}', '{"wide": 3}', "{"):
        with pytest.raises(ValueError):
            quotas(bad)
    assert preset('{"alpha": 0.5, "other": 1}') == Parameters(alpha=0.5)


def test_curate_select_equals_loops(spark):
    vecs = view(spark, SF, "v_vec").collect()
    scene = {(r.pool, r.id): r.scene for r in catalogue.queries()["scene_cluster"](spark, SF).collect()}
    got = {}
    for r in catalogue.queries()["curate_select"](spark, SF).collect():
        got.setdefault(r.pool, []).append((r["rank"], r.id, r.scene, r.category, r.quality, r.redundancy, r.score))
    for pool in {r.scene_hint for r in vecs}:
        scenes = {}
        for r in sorted(vecs, key=lambda r: (-r.q, r.id)):
            if r.scene_hint == pool:
                scenes.setdefault(scene[pool, r.id], []).append({
                    "id": r.id, "path": "", "q": r.q, "category": ("portrait", "closeup", "cowboy", "full", "wide")[r.id % 5], "is_profile": r.id % 9 == 0,
                    "hash": sum(1 << i for i in range(63) if r.embedding[i] > 0), "vec": np.array(r.embedding, float),
                })
        want = [(w[0], w[1], w[3], w[4], *w[6:]) for w in loops_selection(scenes, Parameters(most=30))]
        assert [g[:4] for g in sorted(got[pool])] == [w[:4] for w in want]
        assert all(math.isclose(a, b, abs_tol=2e-6) for g, w in zip(sorted(got[pool]), want) for a, b in zip(g[4:], w[4:]))


def test_picture_measures_equal_loops(spark):
    low_basis = np.array([[math.cos(math.pi * (2 * x + 1) * u / 64) * (0.5**0.5 if u == 0 else 1) for x in range(32)] for u in range(8)])
    got = {r.id: r for r in catalogue.queries()["picture_measures"](spark, SF).collect()}
    for r in view(spark, SF, "v_vec").collect():
        e = np.array(r.embedding, float)
        gray = np.clip(np.floor(128 + 3000.0 * np.outer(e[:32], e[32:])), 0, 255)
        index = lambda i: abs(i) if i < 32 else 62 - i
        bends = [gray[index(y - 1), x] + gray[index(y + 1), x] + gray[y, index(x - 1)] + gray[y, index(x + 1)] - 4 * gray[y, x] for y in range(32) for x in range(32)]
        own = got[r.id]
        assert math.isclose(own.sharpness, math.tanh(math.log1p(np.var(bends) / (gray.mean() ** 2 + 1e-6))), abs_tol=2e-6)
        low = low_basis @ gray @ low_basis.T
        low[0, 0] = 0
        assert own.phash % 2**64 == sum(int(b) << i for i, b in enumerate((low > np.median(low)).ravel()))
        rows, columns = (np.flatnonzero(gray.mean(axis=a) > 10) for a in (1, 0))
        assert (own.left, own.top, own.right, own.bottom) == (columns[0], rows[0], columns[-1] + 1, rows[-1] + 1)
