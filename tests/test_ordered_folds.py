"""Near copies along time and banks with replacement: against loops, and streams against tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import bank
from reelspark.plans import catalogue
from reelspark.plans.bridge import view
from reelspark.streaming import copies

RNG = np.random.default_rng(21)
SPEC = bank.BankSpec(pause=2, most=6, idle=30.0)


def hashes(n=600):
    """Rows: video, microseconds, id and hash; families of hashes that differ in some bits, several rows a moment."""
    base = [int(v) for v in RNG.integers(0, 2**63, 12)]
    rows, at = [], 0
    for k in range(n):
        at += int(RNG.choice([0, 50_000, 400_000, 3_000_000], p=[0.2, 0.4, 0.38, 0.02]))
        flipped = base[int(RNG.integers(0, 12))]
        for b in RNG.choice(64, int(RNG.integers(0, 8)), replace=False):
            flipped ^= 1 << int(b)
        value = flipped - 2**64 if flipped >= 2**63 else flipped
        rows.append((int(RNG.integers(0, 3)), at, k, None if RNG.random() < 0.05 else value))
    return rows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).drop("us")


def hash_frame(spark, rows):
    return frame(spark, rows, "video long, us long, id long, hash long")


def copies_by_loops(rows, most, within):
    want = {}
    for video in {r[0] for r in rows}:
        kept = []
        for _, at, i, h in sorted((r for r in rows if r[0] == video), key=lambda r: (r[1], r[2])):
            near = [k for a, k, x in kept if at - a < within * 1e6 and h is not None and bin((x ^ h) % 2**64).count("1") <= most]
            want[i] = near[0] if near else None
            if h is not None and not near:
                kept.append((at, i, h))
    return want


@pytest.mark.parametrize("most,within", [(0, 5.0), (8, 2.0), (8, 1e6), (63, 1.0)])
def test_near_copies_equal_loops(spark, most, within):
    rows = hashes()
    got = {r.id: r.copy_of for r in copies.near_copies(hash_frame(spark, rows), "video", most, within).collect()}
    assert got == copies_by_loops(rows, most, within)


def test_rows_that_cannot_be_placed(spark):
    rows = [(None, 1, 1, 5), (1, None, 2, 5), (1, 1, None, 5), (1, 2, 4, None), (1, 3, 5, -1), (1, 3, 6, -1), (1, 3, 6, -1), (1, 4, 7, None)]
    got = copies.near_copies(hash_frame(spark, rows), "video", 8, 5.0).collect()
    assert sorted((r.id, r.copy_of or 0) for r in got) == [(4, 0), (5, 0), (6, 5), (6, 5), (7, 0)]
    assert copies.near_copies(hash_frame(spark, []), "video").count() == 0


def streamed(spark, tmp_path, df, make, batches):
    """What a query gives over files that arrive one by one, stopped and started again half-way."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate(batches):
            part.coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
            if k in (len(batches) // 2, len(batches) - 1):
                stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
                run = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
                assert run.trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(str(tmp_path / "out"))


def shuffled(df, rows, last, schema, spark):
    """Rows in four parts, each moment's rows up to two seconds out of order, then a row that closes every time before it."""
    turn = F.floor((F.unix_micros("ts") + F.pmod(F.xxhash64("id"), F.lit(2_000_000))) / (max(r[1] for r in rows) // 4 + 500_001))
    return [df.where(turn == k) for k in range(5)] + [frame(spark, last, schema)]


def test_near_copies_of_a_stream_equal_the_table(spark, tmp_path):
    rows = hashes(300)
    df = hash_frame(spark, rows)
    end = max(r[1] for r in rows) + 10**9
    last = [(v, end + v, 10**6 + v, None) for v in range(3)] + [(9, end + 10**9, 10**6 + 9, None)]
    got = streamed(spark, tmp_path, df, lambda s: copies.near_copies_stream(s, "video", 8, 4.0, "3 seconds"), shuffled(df, rows, last, "video long, us long, id long, hash long", spark))
    assert {r.id: r.copy_of for r in got.where("id < 1000000").collect()} == copies_by_loops(rows, 8, 4.0)


def test_first_of_equal_over_a_restart(spark, tmp_path):
    rows = [(1, k * 1000, k, k % 7) for k in range(60)]
    df = hash_frame(spark, rows)
    got = streamed(spark, tmp_path, df, lambda s: copies.first_of_equal(s, ["video", "hash"]), [df.where(f"id % 3 = {k}") for k in range(3)])
    assert sorted(r.hash for r in got.collect()) == list(range(7))


def bank_rows(n=500):
    base = RNG.normal(size=(10, 6))
    rows, at = [], 0
    for k in range(n):
        at += 40_000_000 if RNG.random() < 0.004 else 40_000
        vec = base[int(RNG.integers(0, 10))] + RNG.normal(size=6) * RNG.choice([0.02, 0.5])
        fd = None if RNG.random() < 0.05 else round(float(RNG.random() * 0.6), 3)
        rows.append((k % 2, at, k, fd, None if RNG.random() < 0.2 else round(float(RNG.random()), 3), None if RNG.random() < 0.05 else [float(x) for x in vec]))
    return rows


SCHEMA = "video long, us long, id long, fd double, q double, vec array<double>"


def bank_by_loops(rows, spec):
    want, a, b, c = [], *spec.weights
    for video in {r[0] for r in rows}:
        held, since, before = [], 10**9, None
        worth = lambda r, others: a * (1 - r["fd"]) + b * (1 - max((float(r["v"] @ o["v"]) for o in others), default=0.0)) + c * r["q"]
        for _, at, i, fd, q, vec in sorted((r for r in rows if r[0] == video), key=lambda r: (r[1], r[2])):
            if before is not None and at - before >= spec.idle * 1e6:
                held, since = [], 10**9
            before, since = at, since + 1
            if fd is None or vec is None or fd > spec.near or since < spec.pause:
                continue
            new = {"i": i, "fd": fd, "q": q or 0.0, "v": np.array(vec) / np.linalg.norm(vec)}
            nearest = max(held, key=lambda r: float(r["v"] @ new["v"]), default=None)
            old = None
            if nearest and float(nearest["v"] @ new["v"]) >= spec.apart:
                old = nearest
            elif len(held) == spec.most:
                old = min(held, key=lambda r: worth(r, [o for o in held if o is not r]))
            if old is None:
                held.append(new)
            else:
                others = [o for o in held if o is not old]
                if worth(new, others) < worth(old, others) + spec.margin:
                    continue
                held[[o is old for o in held].index(True)] = new
            since = 0
            want.append((video, i, "add" if old is None else "replace", None if old is None else old["i"]))
    return sorted(want)


def changes(df):
    return sorted((r.video, r.id, r.kind, r.instead_of) for r in df.collect())


def test_bank_with_replacement_equals_loops(spark):
    rows = bank_rows()
    want = bank_by_loops(rows, SPEC)
    assert changes(bank.managed(frame(spark, rows, SCHEMA), "video", SPEC)) == want
    kinds = [k for _, _, k, _ in want]
    assert kinds.count("replace") > 10 and kinds.count("add") > 2 * SPEC.most  # a pause of more than `idle` empties it
    alone = bank.BankSpec(most=1, pause=1, apart=2.0)
    assert changes(bank.managed(frame(spark, rows, SCHEMA), "video", alone)) == bank_by_loops(rows, alone)


def test_bank_of_odd_rows(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(1, 1, 1, 0.1, None, []), (1, 2, 2, 0.1, None, one), (1, 3, 3, 0.1, 1.0, [1.0]), (1, 4, 4, 0.1, 1.0, [None, 1.0]), (1, 5, 5, 0.1, 1.0, [nan, 1.0]), (1, 6, 6, 0.3, 1.0, one), (1, 7, 7, 0.05, 1.0, one), (None, 8, 8, 0.1, 1.0, one)]
    got = bank.managed(frame(spark, rows, SCHEMA), "video", bank.BankSpec(pause=1))
    assert changes(got) == [(1, 2, "add", None), (1, 7, "replace", 2)]
    assert bank.managed(frame(spark, [], SCHEMA), "video").count() == 0


def test_bank_of_a_stream_equals_the_table(spark, tmp_path):
    rows = bank_rows(300)
    df = frame(spark, rows, SCHEMA)
    end = max(r[1] for r in rows) + 10**9
    last = [(v, end + v, 10**6 + v, None, None, None) for v in range(2)] + [(9, end + 10**9, 10**6 + 9, None, None, None)]
    got = streamed(spark, tmp_path, df, lambda s: bank.managed_stream(s, "video", SPEC, "3 seconds"), shuffled(df, rows, last, SCHEMA, spark))
    assert changes(got.where("id < 1000000")) == bank_by_loops(rows, SPEC)


SF = "/root/testdata/sf0.001"


def test_queries_equal_loops(spark):
    vecs = view(spark, SF, "v_vec").collect()
    sign = lambda v: sum(1 << k for k in range(63) if v[k] > 0)
    rows = [(r.scene_hint, r.id * 500_000, r.id, None if r.id % 13 == 0 else sign(r.embedding)) for r in vecs]
    got = {r.id: r.copy_of for r in catalogue.queries()["copies_in_time"](spark, SF).collect()}
    assert got == copies_by_loops(rows, 20, 60.0) and any(v is not None for v in got.values())
    held = [(r.scene_hint, r.id * 500_000, r.id, (r.id * 53 % 100) / 180.0, None if r.id % 11 == 0 else r.q, None if r.id % 7 == 0 else list(r.embedding)) for r in vecs]
    found = sorted((r.scene_hint, r.id, r.kind, r.instead_of) for r in catalogue.queries()["bank_changes"](spark, SF).collect())
    assert found == bank_by_loops(held, bank.BankSpec(apart=0.4, pause=1, most=8)) and {k for _, _, k, _ in found} == {"add", "replace"}
