import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import images, probe
from reelspark.operators import bank
from reelspark.plans import catalogue, parameters
from reelspark.plans.bridge import view
from reelspark.sources import frames
from reelspark.streaming import capture

SF = "/root/testdata/sf0.001"


def test_raw_frames_with_stride(spark, tmp_path):
    data = np.random.default_rng(0).integers(0, 256, (11, 12), dtype=np.uint8)  # 4 x 2 nv12
    (tmp_path / "v.raw").write_bytes(data.tobytes() + b"torn")
    got = frames.read_frames(spark, str(tmp_path / "v.raw"), 4, 2, stride=2, per_task=3)
    assert [(r.frame_idx, bytes(r.pixels)) for r in got.orderBy("frame_idx").collect()] == [(n, data[n].tobytes()) for n in range(0, 11, 2)]
    assert {len(r.pixels) for r in frames.luma(got).collect()} == {8}
    (tmp_path / "none.raw").write_bytes(b"")
    assert frames.read_frames(spark, str(tmp_path / "none.raw"), 4, 2).count() == 0


def test_pictures_and_sinks(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path[-5:] for r in frames.read_pictures(spark, str(tmp_path)).collect()) == ["a.jpg", "b.PNG"]
    rows = spark.createDataFrame([(1, 0.5, None), (2, None, "f2.jpg")], "frame long, score double, crop_path string")
    frames.write_hits(rows, str(tmp_path / "hits"))
    back = spark.read.csv(str(tmp_path / "hits"), header=True)
    assert sorted((r.frame, r.score, r.crop_path) for r in back.na.fill("").collect()) == [("1", "0.5", ""), ("2", "", "f2.jpg")]
    frames.write_metrics(rows, str(tmp_path / "metrics"), {"dedup": 7})
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "metrics")).collect()]
    assert sorted(d["item"]["frame"] for d in docs) == [1, 2] and docs[0]["config"] == {"dedup": 7}


def test_streaming_streak_equals_batch(spark, tmp_path):
    v = view(spark, SF, "v_frame")
    for part, rule in enumerate(("frame_idx < 3", "frame_idx >= 3")):
        v.where(rule).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = capture.no_face_streak(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r.id, r.streak, -1 if r.since_hit is None else r.since_hit) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(catalogue.queries()["no_face_streak"](spark, SF))


def test_hit_spans(spark):
    rows = spark.createDataFrame([(1, t, 0.1) for t in (0, 3, 20)] + [(1, 40, 0.9)], "video_id long, t long, fd double").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.hits for r in capture.hit_spans(rows).collect()) == [1, 2]


def test_picture_measures_equal_loops(spark):
    rng = np.random.default_rng(1)
    gray = rng.integers(0, 256, (32, 32), dtype=np.uint8)
    total = []
    for y in range(32):
        for x in range(32):
            at = lambda a, b: float(gray[min(a, 62 - a) if a >= 0 else -a, min(b, 62 - b) if b >= 0 else -b])
            total.append(at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x))
    assert np.isclose(images.laplacian_variance(gray), np.var(total))
    low = [[sum(gray[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for v in range(8)] for u in range(8)]
    low = np.array(low)
    low[0, 0] = 0
    want = sum(int(b) << i for i, b in enumerate((low > np.median(low)).ravel()))
    assert images.perceptual_hash(gray) % 2**64 == want
    framed = np.zeros((40, 50), np.uint8)
    framed[5:30, 7:41] = 200
    assert images.content_box(framed) == (7, 5, 41, 30) and images.content_box(framed * 0) == (0, 0, 1, 1)
    bad = spark.createDataFrame([(1, None, 2, 2), (2, bytearray(b"a"), 2, 2), (3, bytearray(b"abcd"), 2, 2)], "id long, pixels binary, w int, h int")
    got = {r.id: r.phash for r in images.measure(bad, ["id"]).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None
    assert images.measure(bad.where("false"), ["id"]).count() == 0


def test_plain_name(spark):
    rows = spark.createDataFrame([("ColorTransfer.SMPTE2084",), (" unknown ",), (None,), ("hlg",)], "t string")
    assert [r[0] for r in rows.select(probe.plain_name(F.col("t"))).collect()] == ["smpte2084", "", "", "hlg"]


def test_planes_of_p010(spark):
    rows = spark.createDataFrame([(0, 4, 2, bytearray(range(24)))], "frame_idx long, w int, h int, pixels binary")
    got = frames.planes(rows).first()
    assert (bytes(got.y), bytes(got.uv)) == (bytes(range(16)), bytes(range(16, 24)))


def test_written_pictures_logs_cache_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("0001.jpg", bytearray(b"one")), ("0002.jpg", None), ("0003.jpg", bytearray(b"three"))], "name string, content binary")
    seen, watched = frames.counted(rows)
    frames.write_pictures(seen, str(tmp_path / "set"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "set").iterdir()} == {"0001.jpg": b"one", "0003.jpg": b"three"}
    assert watched.get["rows"] == 3
    frames.write_log(rows.selectExpr("row_number() OVER (ORDER BY name) AS rank", "name AS file"), str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "log"), header=True).collect()] == [("1", "0001.jpg"), ("2", "0002.jpg"), ("3", "0003.jpg")]
    made = []
    build = lambda: made.append(1) or spark.range(len(made))
    count = lambda mode, settings: frames.cached(spark, str(tmp_path / "cache"), settings, build, mode).count()
    assert [count("auto", {"a": 1}), count("auto", {"a": 1}), count("refresh", {"a": 1}), count("auto", {"a": 1}), count("auto", {"a": 2}), count("off", {"a": 2})] == [1, 1, 2, 2, 3, 4]


def test_sharpness_of_a_large_picture():
    small = np.random.default_rng(3).integers(0, 256, (128, 256)).astype(np.uint8)
    large = np.kron(small, np.ones((2, 2), np.uint8))
    assert np.isclose(images.sharpness(large), images.sharpness(small))
    v = images.laplacian_variance(small) / (small.mean() ** 2 + 1e-6)
    assert np.isclose(images.sharpness(small), np.tanh(np.log1p(v)))


def test_bank_growth(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 8))
    base[50:60] = base[0] * 3
    rows = [(v, i, i, 0.2 if i % 3 else 0.9, [float(x) for x in base[i]]) for v in (1, 2) for i in range(200)] + [(1, 999, 999, None, None)]
    got = bank.grown(spark.createDataFrame(rows, "video long, id long, at long, fd double, vec array<double>"), "video", most=20).collect()
    for v in (1, 2):
        ids = sorted(r.id for r in got if r.video == v)
        units = [base[i] / np.linalg.norm(base[i]) for i in ids]
        assert len(ids) == 20 and all(b - a >= 5 for a, b in zip(ids, ids[1:])) and all(i % 3 for i in ids)
        assert all(a @ b < 0.968 for k, a in enumerate(units) for b in units[:k])


def test_cut_out_and_model_input(spark):
    raw = np.random.default_rng(5).integers(0, 256, (4, 6, 3), dtype=np.uint8)
    boxes = [(1, 1, 1, 4, 3), (2, -5, -5, 100, 100), (3, 4, 2, 4, 3), (4, None, 0, 2, 2)]
    rows = spark.createDataFrame([(i, bytearray(raw.tobytes()), 6, 4, *b) for i, *b in boxes] + [(5, None, 6, 4, 0, 0, 1, 1)], "id long, pixels binary, w int, h int, x1 int, y1 int, x2 int, y2 int")
    got = {r.id: r for r in images.cut_out(rows, ["id"]).collect()}
    assert bytes(got[1].pixels) == raw[1:3, 1:4].tobytes() and (got[1].w, got[1].h) == (3, 2)
    assert bytes(got[2].pixels) == raw.tobytes() and got[3].pixels is None and got[5].pixels is None and bytes(got[4].pixels) == raw[0:2, 0:2].tobytes()
    chip = np.random.default_rng(6).integers(0, 256, (4, 4, 3), dtype=np.uint8)
    made = spark.createDataFrame([([int(x) for x in chip.ravel()],)], "p array<int>").select(images.model_input(F.col("p"), 4).alias("m")).first().m
    assert np.allclose(np.array(made).reshape(3, 4, 4), chip.transpose(2, 0, 1) / 127.5 - 1)


def test_rotation_rule(spark):
    rule = parameters.Rotation(every=-3, after_hit=2, small_size=-1)
    assert (rule.every, rule.after_hit, rule.small_size) == (1, 2, 0)
    rows = spark.createDataFrame([(0, 0, 4), (1, 3, 6), (2, 4, 7), (5, None, 9)], "streak int, since int, n int")
    turns = lambda rule: [r[0] for r in rows.select(rule.turns(F.col("streak"), F.col("since"), F.col("n"))).collect()]
    assert turns(parameters.Rotation(every=3, after_hit=0)) == [True, True, False, True] and turns(parameters.Rotation(adaptive=False)) == [True] * 4


def test_frames_from_a_pipe(spark, tmp_path):
    data = np.random.default_rng(7).integers(0, 256, (10, 18), dtype=np.uint8)  # 3 x 2 rgb24
    (tmp_path / "v.bin").write_bytes(data.tobytes() + b"torn")
    code = "import sys; f = open(sys.argv[1], 'rb'); f.seek(18 * int(sys.argv[2])); sys.stdout.buffer.write(f.read(18 * int(sys.argv[3]) + 5))"
    got = frames.read_pipe(spark, [sys.executable, "-c", code, str(tmp_path / "v.bin"), "{first}", "{count}"], 12, 3, 2, stride=3, per_task=4)
    assert [(r.frame_idx, bytes(r.pixels)) for r in got.orderBy("frame_idx").collect()] == [(n, data[n].tobytes()) for n in (0, 3, 6, 9)]


def test_outlined(spark):
    rows = spark.createDataFrame([(1, bytearray(8 * 6 * 3), 8, 6, [{"x1": 1.0, "y1": 1.0, "x2": 6.0, "y2": 5.0}]), (2, None, 8, 6, []), (3, bytearray(3), 1, 1, None)], "id long, pixels binary, w int, h int, boxes array<struct<x1: double, y1: double, x2: double, y2: double>>")
    got = {r.id: r.pixels for r in images.outlined(rows, ["id"], thick=1).collect()}
    want = np.zeros((6, 8, 3), np.uint8)
    want[1:5, [1, 5]] = want[[1, 4], 1:6] = (0, 255, 0)
    assert bytes(got[1]) == want.tobytes() and got[2] is None and bytes(got[3]) == bytes(3)


def test_frame_filters_reach_the_reader(spark, tmp_path):
    data = np.random.default_rng(0).integers(0, 256, (40, 12), dtype=np.uint8)
    (tmp_path / "v.raw").write_bytes(data.tobytes())
    held = frames.read_frames(spark, str(tmp_path / "v.raw"), 4, 2, stride=2, per_task=4)
    n = F.col("frame_idx")
    for rule, want in (((n >= 7) & (n < 19), range(8, 19, 2)), ((n > 8) & (n <= 12), (10, 12)), (n == 14, (14,)), (n.isin(2, 3, 30) & (n > 2), (30,)), (n.isin(2, 4) & (n == 9), ()), ((n < 6) & (n < 4), (0, 2)), (n > 1000, ()), ((n >= 30) & (F.length("pixels") == 12) & (n != 32), (30, 34, 36, 38))):
        assert sorted((r.frame_idx, bytes(r.pixels)) for r in held.where(rule).collect()) == [(k, data[k].tobytes()) for k in want]
    own = held.where((n >= 7) & (n < 19))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "rawframes" in plan and ") Filter" not in plan and "- Filter" not in plan
    assert own.rdd.getNumPartitions() == 3
    reader = frames.RawFrameReader({"path": str(tmp_path / "v.raw"), "width": "4", "height": "2", "framespertask": "4"})
    assert list(reader.pushFilters([frames.GreaterThan(("frame_idx",), 30), frames.EqualTo(("w",), 4), frames.In(("frame_idx",), (31, 39, None))])) == [frames.EqualTo(("w",), 4)]
    assert [(r.first, r.end) for r in reader.partitions()] == [(31, 35), (39, 40)]


def test_growing_file_is_streamed_once_over_restarts(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 256, (25, 12), dtype=np.uint8)
    path = tmp_path / "v.raw"
    for end, torn in ((7, b"torn"), (7, b"torn"), (16, b""), (25, b"x")):
        path.write_bytes(data[:end].tobytes() + torn)
        run = frames.stream_frames(spark, str(path), 4, 2, per_task=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        assert run.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted((r.frame_idx, bytes(r.pixels)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(n, data[n].tobytes()) for n in range(end)]
    stream = frames.RawFrameStream({"path": str(path), "width": "4", "height": "2"})
    path.write_bytes(data[:3].tobytes())
    with pytest.raises(ValueError, match="shorter"):
        stream.partitions({"frames": 7}, {"frames": 9})


def test_failing_decoder_is_an_error(spark):
    with pytest.raises(Exception, match="ended with 3 after 1 of 4"):
        frames.read_pipe(spark, [sys.executable, "-c", "import sys; sys.stdout.buffer.write(bytes(18)); sys.exit(3)"], 4, 3, 2).collect()
    assert frames.read_pipe(spark, [sys.executable, "-c", "import sys; sys.stdout.buffer.write(bytes(20))"], 4, 3, 2).count() == 1


def test_last_picture_of_a_name_stays(spark, tmp_path):
    rows = spark.createDataFrame([("a", n, k, bytearray([n, k])) for n in (1, 3, 2) for k in (0, 1)] + [("b", 9, 0, None), (None, 9, 0, bytearray(b"x"))], "name string, frame long, person long, content binary")
    frames.write_pictures(rows.repartition(4), str(tmp_path / "set"), ("frame", "person"))
    assert [p.name for p in (tmp_path / "set").iterdir()] == ["a"] and (tmp_path / "set" / "a").read_bytes() == bytes([3, 1])
