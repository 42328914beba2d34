import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reelspark.streaming import lock

SPEC = lock.LockSpec(gap=0.5, misses=2, idle=5.0)
NAMES = lock.NAMES


def faces(spark, rows):
    """Rows: video, seconds, frame, id, fd and box."""
    return spark.createDataFrame(rows, "video_id long, s double, frame_idx long, id long, fd double, x1 double, y1 double, x2 double, y2 double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


def made_up(n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for video in range(4):
        at = 0.0
        for frame in range(n // 4):
            at += 9.0 if rng.random() < 0.02 else 0.04
            for _ in range(rng.integers(1, 4)):
                x, y = float(rng.integers(0, 3) * 200), float(rng.integers(0, 9))
                rows.append((video, round(at, 3), frame, len(rows), None if rng.random() < 0.1 else round(float(rng.random() * 0.9), 2), x, y, x + 50, y + 60))
    return rows


def test_region_is_followed_and_dropped(spark):
    box, far = (100.0, 100.0, 150.0, 160.0), (900.0, 900.0, 950.0, 960.0)
    rows = [(1, 0.0, 0, 10, 0.3, *box), (1, 0.1, 1, 11, 0.2, 110.0, 100.0, 160.0, 160.0), (1, 0.2, 2, 12, 0.4, *box)]
    rows += [(1, 0.3, 3, 13, 0.9, *box), (1, 0.4, 4, 14, 0.9, *box), (1, 0.5, 5, 15, None, *box), (1, 0.6, 6, 16, 0.44, *far), (1, 0.6, 6, 17, 0.43, *box)]
    got = {(r.frame_idx, r.kind): r for r in lock.locked_frames(faces(spark, rows), SPEC).collect()}
    assert [got[f, "hit"].in_region for f in (0, 1, 2)] == [False, True, False]  # the third is not near enough for a lock, but for a search of the frame
    assert got[1, "hit"].x1 == 100.0 and got[2, "hit"].x1 == 0.7 * 100 + 0.3 * 110
    assert [got[f, "miss"].x1 is None for f in (3, 4, 5)] == [False] * 3
    assert got[6, "hit"].id == 17 and got[6, "hit"].x1 is None  # dropped after three misses: no margin is asked
    assert sorted((f, got[f, k].id) for f, k in got if k == "save") == [(1, 11), (6, 17)]


def test_margin_and_first_of_window(spark):
    box, far, third = (0.0, 0.0, 10.0, 10.0), (500.0, 0.0, 510.0, 10.0), (900.0, 0.0, 910.0, 10.0)
    rows = [(1, 0.0, 0, 1, 0.3, *box), (1, 0.1, 1, 2, 0.30, *far), (1, 0.1, 1, 3, 0.31, *third), (1, 0.2, 2, 4, 0.30, *far), (1, 0.2, 2, 5, 0.34, *third)]
    got = {(r.frame_idx, r.kind): r.id for r in lock.locked_frames(faces(spark, rows), lock.LockSpec(only_best=False)).collect()}
    assert got == {(0, "hit"): 1, (1, "miss"): None, (2, "hit"): 4, (0, "save"): 1}


def test_saves_equal_loops(spark):
    got = lock.locked_frames(faces(spark, made_up()), SPEC).toPandas()
    times = {(v, f): s for v, s, f, *_ in made_up()}
    distance = {i: d for _, _, _, i, d, *_ in made_up()}
    for video, own in got.groupby("video_id"):
        frames = sorted(f for v, f in times if v == video)
        hits = dict(own[own.kind == "hit"][["frame_idx", "id"]].itertuples(index=False))
        assert sorted([*hits, *own[own.kind == "miss"].frame_idx]) == frames
        want, opened, window = [], None, []
        for f in sorted(hits):
            if opened is None or round((times[video, f] - opened) * 1e6) >= SPEC.gap * 1e6:
                want += [min(window)[1]] if window else []
                opened, window = times[video, f], []
            window.append((distance[hits[f]], f))
        want += [min(window)[1]] if window else []
        assert sorted(own[own.kind == "save"].frame_idx) == want


def test_edge_rows(spark):
    empty = faces(spark, [(1, 0.0, 0, 1, 0.3, 0.0, 0.0, 1.0, 1.0)]).where("false")
    assert lock.locked_frames(empty).count() == 0
    rows = [(None, 0.0, 0, 1, 0.1, 0.0, 0.0, 1.0, 1.0), (1, None, 0, 1, 0.1, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0, None, 0.1, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0, 7, 0.1, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0, 7, 0.1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1, 9, 0.1, None, 0.0, 1.0, 1.0)]
    got = lock.locked_frames(faces(spark, rows).withColumn("kind", F.lit("clash"))).collect()
    assert sorted((r.frame_idx, r.kind, r.id or 0) for r in got) == [(0, "hit", 7), (0, "save", 7), (1, "miss", 0)]


def test_stream_equals_batch_out_of_order_and_restarted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = made_up(160)
    last = max(r[1] for r in rows)
    want = lock.locked_frames(faces(spark, rows), SPEC).toPandas()
    late = np.random.default_rng(5).random(len(rows)) * 2  # seconds of disorder, less than the watermark's delay
    order = [rows[k] for k in np.argsort([r[1] + d for r, d in zip(rows, late)], kind="stable")]
    cuts = [order[:90], order[90:180], order[180:], [(99, last + 100, 0, -1, None, 0.0, 0.0, 1.0, 1.0)]]

    def run():
        stream = spark.readStream.schema(faces(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = lock.locked_stream(stream, SPEC).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        found = out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert found.awaitTermination(240)

    try:
        for cut in cuts:
            faces(spark, cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()  # each start goes on from the checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    key = lambda p: sorted(repr(tuple(None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6) for v in r)) for r in p[list(want.columns)].itertuples(index=False, name=None))
    assert key(got[got.video_id != 99]) == key(want)
