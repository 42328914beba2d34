"""Sequential scene clustering over ranges of time that run in parallel and hand their state on."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .lineage import cut


@dataclass(frozen=True)
class Likeness:
    similarity: float
    most_bits: int
    window: int


class Rows:
    """A block's rows in order, as arrays."""

    def __init__(self, own: pa.Table, pool: str):
        place = pc.sort_indices(own, sort_keys=[(c, "ascending") for c in (pool, "ts", "path", "id")], null_placement="at_start")
        self.table = own = own.take(place)
        block = own.column("block")[0].as_py()
        clips = own.column("clip").to_pylist()
        width = max((len(c) for c in clips if c is not None), default=0)
        self.has = np.array([c is not None for c in clips])
        self.clip = np.array([np.pad(np.asarray(c if c is not None else [], float), (0, width - len(c or []))) for c in clips]).reshape(len(clips), width)
        self.norm = np.linalg.norm(self.clip, axis=1) + 1e-6
        self.hash = own.column("hash").to_numpy().astype(np.int64).view(np.uint64)
        self.q = own.column("q").to_numpy().astype(float)
        self.key = (block << 32) + np.arange(len(clips))
        pools = own.column(pool).to_pylist()
        self.pool = pools[0], pools[-1]
        #: Where a new pool begins, and the end.
        self.parts = [i for i in range(len(pools)) if i == 0 or pools[i] != pools[i - 1]] + [len(pools)]


class Medoids:
    """The last clusters of a pool: key (place of the first row), medoid and when each came to be. What is met next depends on nothing else."""

    def __init__(self, rules: Likeness, width: int, packed: bytes = b""):
        size = max(1, rules.window)
        found = np.frombuffer(packed, np.int64)
        held = found.reshape(int(found[0]), -1)[:, 1:] if len(found) else np.zeros((0, 5 + width), np.int64)
        width = max(width, held.shape[1] - 5)
        n = len(held)
        self.rules, self.count = rules, n
        self.clip = np.zeros((size, width))
        self.clip[:n, : held.shape[1] - 5] = held[:, 5:].view(float)
        self.key, self.medoid, self.born = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1)
        self.hash, self.q, self.has = np.zeros(size, np.uint64), np.zeros(size), np.zeros(size, bool)
        self.key[:n], self.medoid[:n], self.born[:n] = held[:, 0], held[:, 1], np.arange(n)
        self.hash[:n], self.q[:n], self.has[:n] = held[:, 2].view(np.uint64), np.ascontiguousarray(held[:, 3]).view(float), held[:, 4] == 1
        self.norm = np.linalg.norm(self.clip, axis=1) + 1e-6

    def meet(self, rows: Rows, i: int) -> int:
        """The key of the cluster that row i joins or opens."""
        near = np.bitwise_count(self.hash ^ rows.hash[i]) <= self.rules.most_bits
        if rows.has[i]:
            width = rows.clip.shape[1]
            near |= self.has & ((self.clip[:, :width] * rows.clip[i]).sum(axis=1) / (self.norm * rows.norm[i]) >= self.rules.similarity)
        near &= self.born >= 0
        if near.any():
            slot = int(np.argmax(np.where(near, self.born, -1)))
            if not rows.q[i] > self.q[slot]:
                return int(self.key[slot])
        else:
            slot = self.count % len(self.born)
            self.born[slot], self.key[slot], self.count = self.count, rows.key[i], self.count + 1
        self.medoid[slot], self.hash[slot], self.q[slot] = rows.key[i], rows.hash[i], rows.q[i]
        self.has[slot], self.norm[slot], self.clip[slot] = rows.has[i], rows.norm[i], 0.0
        self.clip[slot, : rows.clip.shape[1]] = rows.clip[i]
        return int(self.key[slot])

    def _order(self) -> np.ndarray:
        return np.argsort(self.born)[int((self.born < 0).sum()) :]

    def same(self, other: Medoids) -> bool:
        a, b = self._order(), other._order()
        return len(a) == len(b) and bool((self.medoid[a] == other.medoid[b]).all() and (self.key[a] == other.key[b]).all())

    def packed(self) -> bytes:
        """The same bytes for the same state."""
        o = self._order()
        width = self.clip.shape[1] if self.clip[o].any() else 0
        told = [self.key[o], self.medoid[o], self.hash[o].view(np.int64), self.q[o].view(np.int64), self.has[o].astype(np.int64), *np.ascontiguousarray(self.clip[o].T[:width]).view(np.int64)]
        return np.column_stack([np.full(len(o), len(o)), *told]).astype(np.int64).tobytes()


def _walk(rows: Rows, start: bytes, rules: Likeness) -> tuple[np.ndarray, bytes]:
    """The cluster of every row, and the state after the last one."""
    found, state = np.zeros(len(rows.key), np.int64), None
    for a, b in zip(rows.parts, rows.parts[1:]):
        state = Medoids(rules, rows.clip.shape[1], start if a == 0 else b"")
        for i in range(a, b):
            found[i] = state.meet(rows, i)
    return found, state.packed()


def _walk_again(rows: Rows, start: bytes, end: bytes, new: bytes, rules: Likeness) -> bytes:
    """The state after the last row if the first meets `new`, not `start`, which led to `end`: both are followed until they are one."""
    if len(rows.parts) > 2:
        return end  # another pool begins inside
    old, now = (Medoids(rules, rows.clip.shape[1], s) for s in (start, new))
    for i in range(len(rows.key)):
        if i % 32 == 0 and old.same(now):
            return end
        old.meet(rows, i)
        now.meet(rows, i)
    return now.packed()


def in_blocks(rows: DataFrame, order: list[str], block_rows: int) -> DataFrame:
    """rows, stored, with their block: ranges of the order, of about block_rows / 2 rows each."""
    blocks = max(1, math.ceil(2 * rows.count() / block_rows))
    return cut(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()))


def cluster_scenes(rows: DataFrame, pool: str, similarity: float = 0.92, most_bits: int = 7, gap: float = 4.0, window: int = 64, block_rows: int = 20_000) -> DataFrame:
    """pool, id and scene. Columns read: id, ts, path, hash, clip (vector or null), q.

    A row joins the newest of the last `window` clusters whose medoid is near in hash or
    vector, and becomes its medoid if its quality is higher; else it opens a cluster.
    Neighbouring clusters are then stitched if their adjoining rows are near in time and
    alike.

    Rows are dealt into blocks by range of pool and time, about block_rows / 2 to a block;
    a task holds one block. All blocks run at once from an empty state. Where the state
    that the block before ended with differs from the one a block began with, it is walked
    again, only until both walks agree; this is repeated until all states fit. In the worst
    case, a pool that opens fewer than `window` clusters, that is as many rounds as the
    pool has blocks. Clusters are then joined, numbered and stitched as rows.
    """
    rules = Likeness(similarity, most_bits, window)
    placed = in_blocks(rows.select(pool, "id", "ts", "path", "hash", "clip", "q"), [pool, "ts", "path", "id"], block_rows)
    kind = rows.schema[pool].dataType.simpleString()

    def begin(own: pa.Table) -> pa.Table:
        own = Rows(own, pool)
        pools = own.table.column(pool)
        return pa.table([own.table.column("block").slice(0, 1), pools.slice(0, 1), pools.slice(len(pools) - 1), pa.array([b""]), pa.array([_walk(own, b"", rules)[1]])], ["block", "first_pool", "last_pool", "start", "end"])

    def resume(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own):
            return told.select(["block", "new", "end"]).slice(0, 0).rename_columns(["block", "start", "end"])
        start, end, new = (told.column(c)[0].as_py() for c in ("start", "end", "new"))
        return pa.table([told.column("block"), pa.array([new]), pa.array([_walk_again(Rows(own, pool), start, end, new, rules)])], ["block", "start", "end"])

    def label(own: pa.Table, told: pa.Table) -> pa.Table:
        own = Rows(own, pool)
        key, n = _walk(own, told.column("start")[0].as_py(), rules)[0], len(own.key)
        edge = np.zeros(n, bool)
        edge[np.unique(key, return_index=True)[1]] = True
        edge[n - 1 - np.unique(key[::-1], return_index=True)[1]] = True
        names = ["ts", "hash", "clip"]
        shown = pa.StructArray.from_arrays([own.table.column(c).combine_chunks() for c in names], names, mask=pa.array(~edge))
        return pa.table([own.table.column(pool), own.table.column("id"), pa.array(own.key), pa.array(key), shown], [pool, "id", "place", "cluster", "edge"])

    first = cut(placed.groupBy("block").applyInArrow(begin, f"block int, first_pool {kind}, last_pool {kind}, start binary, end binary"))
    ends = first.select("block", "start", "end")
    order = Window.orderBy("block")  # a row a block
    turns = cut(first.select("block", F.lag("block").over(order).alias("before"), F.col("first_pool").eqNullSafe(F.lag("last_pool").over(order)).alias("goes_on"))).where("goes_on AND before IS NOT NULL").select("block", "before")
    while True:
        wrong = cut(turns.join(ends.select(F.col("block").alias("before"), F.col("end").alias("new")), "before").join(ends, "block").where("new <> start").select("block", "start", "end", "new"))
        if wrong.isEmpty():
            break
        met = placed.join(wrong.select("block"), "block", "left_semi").groupBy("block").cogroup(wrong.groupBy("block"))
        ends = cut(ends.join(wrong.select("block"), "block", "left_anti").unionByName(met.applyInArrow(resume, "block int, start binary, end binary")))

    clip, path = (rows.schema[c].dataType.simpleString() for c in ("clip", "id"))
    shown = f"struct<ts: {rows.schema['ts'].dataType.simpleString()}, hash: {rows.schema['hash'].dataType.simpleString()}, clip: {clip}>"
    labelled = cut(placed.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(label, f"`{pool}` {kind}, id {path}, place long, cluster long, edge {shown}"))
    return _stitched(labelled, pool, rules, gap)


def _stitched(labelled: DataFrame, pool: str, rules: Likeness, gap: float) -> DataFrame:
    """Scenes of labelled rows. A cluster is compared with the one that came to be before it, in its block or, for a block's first, in an earlier one."""
    clusters = labelled.where("edge IS NOT NULL").groupBy("cluster").agg(F.first(pool).alias("pool"), F.min_by("edge", "place").alias("first"), F.max_by("edge", "place").alias("last")).withColumn("home", F.shiftright("cluster", 32))
    inside = Window.partitionBy("pool", "home").orderBy("cluster")
    clusters = cut(clusters.withColumn("prior", F.lag("last").over(inside)))
    along = Window.partitionBy("pool").orderBy("home")  # a row a block
    carried = clusters.groupBy("pool", "home").agg(F.max_by("last", "cluster").alias("tail")).select(F.col("pool").alias("c_pool"), F.col("home").alias("c_home"), F.lag("tail").over(along).alias("carried"))
    met = clusters.join(carried, (F.col("home") == F.col("c_home")) & F.col("pool").eqNullSafe(F.col("c_pool"))).withColumn("prior", F.coalesce("prior", "carried"))
    alike = (vectors.hamming(F.col("first.hash"), F.col("prior.hash")) <= rules.most_bits) | F.coalesce(vectors.cosine(F.col("first.clip"), F.col("prior.clip")) >= rules.similarity, F.lit(False))
    goes_on = F.lit(rules.window > 0) & F.coalesce((F.abs(F.col("first.ts") - F.col("prior.ts")) <= gap) & alike, F.lit(False))
    numbered = cut(met.select("pool", "home", "cluster", F.when(goes_on, 0).otherwise(1).alias("new")))
    offsets = numbered.groupBy("pool", "home").agg(F.sum("new").alias("own")).select(F.col("pool").alias("o_pool"), F.col("home").alias("o_home"), F.coalesce(F.sum("own").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    local = numbered.withColumn("n", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    scenes = local.join(offsets, (F.col("home") == F.col("o_home")) & F.col("pool").eqNullSafe(F.col("o_pool"))).select("cluster", (F.col("offset") + F.col("n") - 1).cast("int").alias("scene"))
    return labelled.join(scenes, "cluster").select(pool, "id", "scene")

