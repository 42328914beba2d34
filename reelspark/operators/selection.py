"""Quota selection of ranked candidates: minimums by category first, then the rest by best score.

No task holds a pool. A pick takes the best of the scenes' first eligible rows, and what a
row is worth, and whether it is barred, only ever goes down as picks are made. So rounds
suffice, in which a task of each pool gets a bounded head of it: the scenes of the largest
bounds of each category and the first rows of each of their lists. It picks as long as its
best offer is worth more than the bound of all that it was not given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Category, least, most; in this order. "profile" is a cap only (fixed values).
QUOTAS = (("portrait", 60, 100), ("closeup", 35, 60), ("cowboy", 20, 35), ("full", 8, 20), ("wide", 5, 20), ("profile", 0, 20))


@dataclass(frozen=True)
class Quotas:
    quotas: tuple[tuple[str, int, int], ...] = QUOTAS
    most: int = 200
    alpha: float = 0.75
    most_bits: int = 7
    soft_cap: int = 0
    soft_penalty: float = 0.08
    no_vector: float = 0.10


READ = ["id", "scene", "place", "category", "is_profile", "q", "hash", "vec"]
LOG = "rank int, id long, scene int, place long, category string, is_profile boolean, quality double, redundancy double, score double, hash long, vec array<double>"
STATE = "stage int, taken int, done boolean"


def _matrix(vecs: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros, and which are there."""
    has = np.array([v is not None for v in vecs], bool)
    width = max((len(v) for v in vecs if v is not None), default=0) if width is None else width
    table = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        if v is not None:
            table[i, : len(v)] = v[:width]
    return table, has


def _again(again: np.ndarray, table: np.ndarray, has: np.ndarray, vec: np.ndarray | None, rules: Quotas) -> np.ndarray:
    """Redundancy of rows after one more pick, which counts only if it has a vector; each row's sum is its own, so that equal rows stay equal."""
    if vec is None:
        return again
    return np.where(has, np.maximum(again, (table[:, : len(vec)] * vec[: table.shape[1]]).sum(axis=1)), rules.no_vector)


def _far(hashes: np.ndarray, picked: int, rules: Quotas) -> np.ndarray:
    return np.bitwise_count(hashes.view(np.uint64) ^ np.uint64(picked % (1 << 64))) > rules.most_bits


class Round:
    """What one task picks of a pool from its heads."""

    def __init__(self, heads: pa.Table, told: dict, rules: Quotas):
        self.rules, self.caps = rules, {c: most for c, _, most in rules.quotas}
        heads = heads.sort_by([("scene", "ascending"), ("place", "ascending")])
        self.rows = heads.select(READ).to_pylist()
        column = lambda c, t: heads.column(c).to_numpy().astype(t)
        self.scene, self.place, self.q, self.again = column("scene", np.int64), column("place", np.int64), column("q", float), column("again", float)
        self.hash, self.profile = column("hash", np.int64), np.array([bool(r["is_profile"]) for r in self.rows], bool)
        self.table, self.has = _matrix([r["vec"] for r in self.rows])
        names = sorted({r["category"] for r in self.rows} | {b["category"] for b in told["bounds"] or []} | set(self.caps), key=lambda c: (c is None, c))
        self.number = {c: k for k, c in enumerate(names)}
        self.category = np.array([self.number[r["category"]] for r in self.rows], np.int64)
        #: The most that a row of a scene that is not here can be worth, by category.
        self.beyond = np.full(len(names), -np.inf)
        for b in told["bounds"] or []:
            self.beyond[self.number[b["category"]]] = b["bound"]
        self.names = names
        # Lists of one scene, category and profile flag; cut ones go on beyond their last row.
        self.list = np.unique(np.column_stack([self.scene, self.category, self.profile]), axis=0, return_inverse=True)[1].ravel() if self.rows else np.zeros(0, np.int64)
        n = int(self.list.max(initial=-1)) + 1
        at = np.zeros(n, np.int64)
        at[self.list] = np.arange(len(self.rows))  # the last row of each list
        self.last, self.cut, self.bound = at, column("more", bool)[at], column("bound", float)[at]
        self.alive = np.ones(len(self.rows), bool)
        self.picked, self.counts, self.by_scene, self.log = told["n"] or 0, {}, {}, []
        for p in told["picks"] or []:
            self._count(p["category"], p["is_profile"], p["scene"])
        self.limit, self.stage, self.taken, self.done = min(rules.most, told["size"]), told["stage"], told["taken"], False
        self.fresh = True  # the best of the scenes' first rows for this stage is surely among the heads

    def _count(self, category, profile, scene) -> None:
        for c in [category, *["profile"] * bool(profile)]:
            self.counts[c] = self.counts.get(c, 0) + 1
        self.by_scene[scene] = self.by_scene.get(scene, 0) + 1

    def _pick(self, wanted: np.ndarray, penalised: bool) -> bool | None:
        """Picks the best offer: True; there is none: False; what is not here could be better: None."""
        free = not self.counts.get("profile", 0) >= self.caps.get("profile", self.rules.most)
        open_ = self.alive & wanted[self.category] & (free | ~self.profile)
        rows = np.flatnonzero(open_)
        rows = rows[np.concatenate([[True], self.scene[rows][1:] != self.scene[rows][:-1]])] if len(rows) else rows
        score = self.rules.alpha * self.q[rows] - (1 - self.rules.alpha) * self.again[rows]
        if penalised:
            full = {s for s, n in self.by_scene.items() if 0 < self.rules.soft_cap <= n}
            score = score - np.array([self.rules.soft_penalty if s in full else 0.0 for s in self.scene[rows].tolist()])
        i = int(np.argmax(score)) if len(rows) else -1
        best = float(score[i]) if len(rows) else -np.inf
        if not self.fresh:
            beyond = self.beyond[wanted].max(initial=-np.inf)
            if beyond > -np.inf and beyond >= best:
                return None
            dry = self.cut & (np.bincount(self.list[self.alive], minlength=len(self.cut)) == 0) & wanted[self.category[self.last]] & (free | ~self.profile[self.last]) & (self.bound >= best)
            head = dict(zip(self.scene[rows].tolist(), self.place[rows].tolist()))
            if any(head.get(int(self.scene[k]), np.inf) > self.place[k] for k in self.last[dry]):
                return None
        self.fresh = False
        if i < 0:
            return False
        i = int(rows[i])
        row = self.rows[i]
        self.picked += 1
        self.log.append((self.picked, row["id"], row["scene"], row["place"], row["category"], bool(row["is_profile"]), row["q"], float(self.again[i]), best, row["hash"], row["vec"]))
        self._count(row["category"], row["is_profile"], row["scene"])
        self.alive[i] = False
        self.alive &= _far(self.hash, row["hash"], self.rules)
        self.again = _again(self.again, self.table, self.has, self.table[i] if self.has[i] else None, self.rules)
        return True

    def run(self) -> None:
        quotas = [(c, least) for c, least, _ in self.rules.quotas]
        while self.stage < len(quotas):
            category, least = quotas[self.stage]
            wanted = np.array([c == category for c in self.names], bool)
            target = 0 if category == "profile" else min(least, self.limit - (self.picked - self.taken))
            while self.taken < target:
                got = self._pick(wanted, False)
                if got is None:
                    return
                if not got:
                    break
                self.taken += 1
            self.stage, self.taken, self.fresh = self.stage + 1, 0, False
        while self.picked < self.limit:
            got = self._pick(np.array([self.counts.get(c, 0) < self.caps.get(c, self.rules.most) for c in self.names], bool), True)
            if got is None:
                return
            if not got:
                break
        self.done = True


def select_by_quota(rows: DataFrame, pool: str, rules: Quotas = Quotas(), block_rows: int = 20_000, scenes: int = 128, depth: int = 16) -> DataFrame:
    """pool, rank, id, scene, category, quality, redundancy and score. Columns read: id, scene, place, category, is_profile, q, hash, vec.

    A task holds at most about block_rows rows, or a head: `scenes` of each category, the
    scenes of the best first rows (one more than can be penalised), and `depth` rows of
    each of their lists by category and profile flag. A round makes one pick at least.
    """
    kind = rows.schema[pool].dataType.simpleString()
    slim = cut(rows.select(F.struct(pool).alias("pool"), "id", "scene", F.col("place").cast("long").alias("place"), "category", F.coalesce("is_profile", F.lit(False)).alias("is_profile"), "q", "hash", F.col("vec").cast("array<double>").alias("vec")))
    sizes = cut(slim.groupBy("pool").agg(F.count(F.lit(1)).alias("size")))
    parts = F.ceil(F.col("size") / block_rows).cast("int")
    items = slim.join(sizes, "pool").withColumn("part", F.pmod(F.xxhash64("id", "place"), parts).cast("int")).drop("size").withColumn("again", F.lit(0.0))
    state = sizes.select("pool", F.lit(0).alias("stage"), F.lit(0).alias("taken"))
    kinds = f"pool struct<`{pool}`: {kind}>"
    worth = rules.alpha * F.col("q") - (1 - rules.alpha) * F.col("again")
    quotas = F.array(*[F.lit(c) for c, _, _ in rules.quotas])
    caps = F.create_map(*[F.lit(x) for c, _, most in rules.quotas for x in (c, most)])
    logs: list[DataFrame] = []

    def update(own: pa.Table, new: pa.Table) -> pa.Table:
        """Rows that are still to be had, with their redundancy after new picks."""
        if not len(own) or not len(new):
            return own
        hashes, again = own.column("hash").to_numpy().astype(np.int64), own.column("again").to_numpy()
        table, has = _matrix(own.column("vec").to_pylist())
        here = own.column("scene").to_numpy().astype(np.int64), own.column("place").to_numpy()
        left = np.ones(len(own), bool)
        for p in new.to_pylist():
            left &= _far(hashes, p["hash"], rules) & ~((here[0] == p["scene"]) & (here[1] == p["place"]))
            again = _again(again, table, has, None if p["vec"] is None else np.asarray(p["vec"], float), rules)
        return own.set_column(own.column_names.index("again"), "again", pa.array(again)).filter(pa.array(left))

    def choose(heads: pa.Table, told: pa.Table) -> pa.Table:
        row = told.to_pylist()[0]
        found = Round(heads, row, rules)
        found.run()
        n, key = len(found.log), told.column("pool").combine_chunks()
        names = [c.split()[0] for c in LOG.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        columns = [pa.array([*(x[k] for x in found.log), None], t) for k, t in enumerate(types)]
        last = [pa.array([None] * n + [x], t) for x, t in ((found.stage, pa.int32()), (found.taken, pa.int32()), (found.done, pa.bool_()))]
        return pa.table([key.take(pa.array([0] * (n + 1))), *columns, *last], ["pool", *names, "stage", "taken", "done"])

    while True:
        items = cut(items)
        taken = [log.groupBy("pool").agg(F.collect_list(F.struct("scene", "category", "is_profile")).alias("picks")) for log in logs]
        made = None
        for t in taken:
            made = t if made is None else made.unionByName(t)
        made = (made if made is not None else sizes.select("pool", F.array().cast("array<struct<scene: int, category: string, is_profile: boolean>>").alias("picks")).limit(0)).groupBy("pool").agg(F.flatten(F.collect_list("picks")).alias("picks"))
        now = cut(state.join(sizes, "pool").join(made, "pool", "left").withColumn("n", F.coalesce(F.size("picks"), F.lit(0))))
        count = lambda c: F.size(F.filter("picks", lambda p: p["category"].eqNullSafe(c)))
        free = F.coalesce(F.size(F.filter("picks", lambda p: p["is_profile"])), F.lit(0)) < dict((c, most) for c, _, most in rules.quotas).get("profile", rules.most)
        # What each scene's lists are worth at most, and what their first row is worth now.
        eligible = items.join(now.select("pool", free.alias("free")), "pool").where("free OR NOT is_profile")
        bounds = cut(eligible.groupBy("pool", "scene", "category").agg(F.max(worth).alias("bound"), F.min_by(worth, "place").alias("head"), F.min("place").alias("place")))
        wanted = F.when(F.col("stage") < len(rules.quotas), F.col("category").eqNullSafe(F.get(quotas, F.col("stage")))).otherwise(F.coalesce(count(F.col("category")), F.lit(0)) < F.coalesce(F.element_at(caps, F.coalesce("category", F.lit(""))), F.lit(rules.most)))
        best = Window.partitionBy("pool", "category").orderBy(F.desc("bound"), "scene")
        large = bounds.withColumn("n", F.row_number().over(best)).where(F.col("n") <= scenes).select("pool", "scene")
        first = bounds.join(now.select("pool", "stage", "picks"), "pool").where(wanted).groupBy("pool", "scene").agg(F.min_by("head", "place").alias("head"))
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("head"), "scene"))).where(F.col("n") <= rules.most + 1).select("pool", "scene")
        chosen = cut(large.unionByName(first).distinct())
        beyond = bounds.join(chosen, ["pool", "scene"], "left_anti").groupBy("pool", "category").agg(F.max("bound").alias("bound")).groupBy("pool").agg(F.collect_list(F.struct("category", "bound")).alias("bounds"))
        known = bounds.select(F.col("pool").alias("b_pool"), F.col("scene").alias("b_scene"), F.col("category").alias("b_category"), "bound")
        lists = Window.partitionBy("pool", "scene", "category", "is_profile").orderBy("place")
        listed = eligible.join(chosen, ["pool", "scene"], "left_semi").withColumn("n", F.row_number().over(lists)).where(F.col("n") <= depth + 1)
        heads = listed.withColumn("more", F.max("n").over(lists.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > depth).where(F.col("n") <= depth)
        heads = heads.join(known, (F.col("pool") == F.col("b_pool")) & (F.col("scene") == F.col("b_scene")) & F.col("category").eqNullSafe(F.col("b_category"))).select("pool", *READ, "again", "more", "bound")
        told = now.join(beyond, "pool", "left").select("pool", "size", "stage", "taken", "n", "picks", "bounds")
        out = cut(heads.groupBy("pool").cogroup(told.groupBy("pool")).applyInArrow(choose, f"{kinds}, {LOG}, {STATE}"))
        log = out.where("rank IS NOT NULL").drop("stage", "taken", "done")
        logs.append(log)
        state = out.where("rank IS NULL AND NOT done").select("pool", "stage", "taken")
        if state.isEmpty():
            break
        dealt = log.join(state, "pool", "left_semi").join(sizes, "pool").select("pool", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "scene", "place", "hash", "vec")
        left = items.join(state, "pool", "left_semi").select("pool", "part", *READ, "again")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)
        items = left.groupBy("pool", "part").cogroup(dealt.groupBy("pool", "part")).applyInArrow(update, schema)
    found = logs[0]
    for log in logs[1:]:
        found = found.unionByName(log)
    return found.select(F.col(f"pool.{pool}").alias(pool), "rank", "id", "scene", "category", "quality", "redundancy", "score")
