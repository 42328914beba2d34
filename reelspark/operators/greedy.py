"""Greedy operators that depend on order: each group's rows are folded in a total order inside one expression."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.vectors import dot, hamming
from .lineage import cut


def _kept(rows: Column, clashes) -> Column:
    """rows, in order, without those that clash with one kept before."""
    empty = F.filter(rows, lambda x: F.lit(False))
    return F.aggregate(rows, empty, lambda kept, x: F.when(F.exists(kept, lambda k: clashes(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def drop_near_hashes(rows: DataFrame, group: list[str], order: list[str], key: str, most: int) -> DataFrame:
    """In each group, in order, drops a row whose hash is within `most` bits of any kept one. Not transitive, so no clustering can replace it."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(key))))
    kept = _kept(packed, lambda k, x: hamming(k[key], x[key]) <= most)
    return rows.groupBy(*group).agg(kept.alias("kept")).select(*group, F.inline("kept"))


#: A lookup, which is shuffled and held in memory, counts as so many rows met in a bucket: a rough estimate, not tuned.
LOOKUP = 16


def _lookup(rows: int, most: int, bits: list[int]) -> tuple[list[int], list[list[int]], float]:
    """Into which segments to cut the bits that vary, what a lookup in each must try, and what a row's lookups cost, in rows.

    Of m segments at least one differs in at most most // m bits. Few long segments need
    many lookups, many short ones meet many rows; the cheapest for that many rows is taken.
    """
    best = None
    for parts in range(1, min(16, max(1, len(bits))) + 1):
        width, radius = len(bits) // parts, most // parts
        lookups = parts * sum(math.comb(width, r) for r in range(min(radius, width) + 1))
        weight = lookups * (LOOKUP + rows / 2**width)
        if best is None or weight < best[0]:
            best = weight, parts, width, radius, lookups
    _, parts, width, radius, lookups = best
    cost = lookups * (1 + rows / 2**width)
    if lookups > 1024:
        return [], [], math.inf
    cuts = [bits[s * width : (s + 1) * width] for s in range(parts)]
    signed = lambda at: (n := sum(1 << i for i in at)) - (1 << 64 if n >= 1 << 63 else 0)
    return [signed(c) for c in cuts], [[signed(x) for r in range(min(radius, width) + 1) for x in combinations(c, r)] for c in cuts], cost


def _known(hashes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as unsigned numbers, and which are there."""
    return pc.fill_null(hashes.cast(pa.int64()), 0).to_numpy().view(np.uint64), pc.is_valid(hashes).to_numpy()


def _settled(own: pa.Table, key: str, most: int) -> pa.Table:
    """What is kept of a group's rows in the order of k."""
    own = own.sort_by("k")
    hashes, known = _known(own.column(key))
    alive = np.ones(len(own), bool)
    for i in range(len(own)):
        if alive[i] and known[i]:
            alive[i + 1 :] &= (np.bitwise_count(hashes[i + 1 :] ^ hashes[i]) > most) | ~known[i + 1 :]
    return own.filter(pa.array(alive))


def _untouched(own: pa.Table, new: pa.Table, key: str, most: int) -> pa.Table:
    """Rows that are near none of the new ones."""
    if not len(own) or not len(new):
        return own
    hashes, known = _known(own.column(key))
    left, given = np.arange(len(own)), _known(new.column(key))
    for h in given[0][given[1]]:
        left = left[(np.bitwise_count(hashes[left] ^ h) > most) | ~known[left]]
        if not len(left):
            break
    return own.take(pa.array(left))


def _kept_by_blocks(first: DataFrame, key: str, most: int, block_rows: int) -> list[DataFrame]:
    """The k of rows kept, a round after another: the next rows of each group settle in one task, the blocks behind them drop what is near."""
    left = cut(first.select("g", "k", key, F.expr(f"k div {block_rows}").alias("block")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    found = []
    while True:
        sizes = left.groupBy("g", "block").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("block"))
        turn = cut(sizes.withColumn("now", (upto <= block_rows) | (upto == F.col("n"))))
        if turn.isEmpty():
            return found
        after = turn.where("NOT now").select("g", "block")
        kept = cut(left.join(turn.where("now"), ["g", "block"], "left_semi").groupBy("g").applyInArrow(lambda own: _settled(own, key, most), schema))
        found.append(kept.select("k"))
        told = kept.select("g", key).join(after, "g")
        left = cut(left.join(after, ["g", "block"], "left_semi").groupBy("g", "block").cogroup(told.groupBy("g", "block")).applyInArrow(lambda own, new: _untouched(own, new, key, most), schema))


def _lost_by_lookups(first: DataFrame, key: str, most: int, segments: list[int], masks: list[list[int]], n: int) -> list[DataFrame]:
    """The k of rows dropped, by rounds of stars, then by the pairs that are left."""
    left = first
    part = lambda s: F.col(key).bitwiseAND(F.lit(segments[s]).cast("long"))
    bucket = lambda s, m: F.xxhash64("g", F.lit(s), part(s).bitwiseXOR(m))  # noqa: E731  rows of other buckets that share it are sorted out
    tried = lambda s: F.transform(F.array(*[F.lit(m).cast("long") for m in masks[s]]), lambda m: bucket(s, m))
    each = range(len(segments))
    held = lambda df, *more: df.select(F.col("k").alias("h"), *[F.col(c).alias(f"h_{c}") for c in more], F.explode(F.array(*[bucket(s, F.lit(0).cast("long")) for s in each])).alias("b"))
    asking = lambda df, *more: df.select(F.col("k").alias("a"), *[F.col(c).alias(f"a_{c}") for c in more], F.explode(F.flatten(F.array(*[tried(s) for s in each]))).alias("b"))
    follows = (F.col("a") < F.col("h")) & (hamming(F.col(f"a_{key}"), F.col(f"h_{key}")) <= most) & F.col("a_g").eqNullSafe(F.col("h_g"))
    met = lambda those, all_: asking(those, key, "g").join(held(all_, key, "g"), "b").where(follows)
    lost = []
    while n:
        least = held(left).groupBy("b").agg(F.min("h").alias("first"))
        free = asking(left).join(least, "b").groupBy("a").agg(F.min("first").alias("first")).where("first = a").select(F.col("a").alias("k"))
        kept = cut(left.join(free, "k"))
        gone = cut(met(kept, left).select(F.col("h").alias("k")).distinct())
        lost.append(gone)
        left = cut(left.join(kept.select("k").unionByName(gone), "k", "left_anti"))
        before, n = n, left.count()
        if before - n < before / 8:
            break
    pairs = cut(met(left, left).select("a", F.col("h").alias("b")).distinct())
    while not pairs.isEmpty():
        kept = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")), "a", "left_anti")
        gone = cut(pairs.join(kept, "a", "left_semi").select("b").distinct())
        lost.append(gone.select(F.col("b").alias("k")))
        out = kept.unionByName(gone.select(F.col("b").alias("a")))
        pairs = cut(pairs.join(out, "a", "left_anti").join(gone, "b", "left_anti"))
    return lost


def drop_near_hashes_everywhere(rows: DataFrame, order: list[str], key: str, most: int, group: list[str] = [], block_rows: int = 20_000, by_lookups: bool | None = None) -> DataFrame:
    """As drop_near_hashes, but no task holds a group (by default all rows are one): group, order and key of the rows kept. The order must be total.

    Of equal hashes only the first can be kept. Rows are numbered in their order, so that
    all that is shuffled afterwards is a number, a hash and a group. Where that is cheaper
    (or by_lookups says so), hashes are looked up by segments of the bits that vary, the
    number of which follows the number of rows. First come rounds of stars: a row that is
    the first of all undecided rows in the buckets it looks up is kept, and drops the
    later rows near it, so that a cluster of near copies costs a comparison for each of
    its rows, not one for each pair. Once a round drops less than an eighth of the rows,
    the pairs that are left are found, and rows without an undecided earlier neighbour are
    kept and drop their later ones; there are as many rounds as the longest chain of
    dependent rows. Else, as with thresholds so wide that a lookup meets about as many rows
    as there are, rows meet the kept ones block by block: each row is compared once with
    each row kept before it.
    """
    g = F.struct(*group).alias("g") if group else F.lit(0).alias("g")
    least = cut(rows.groupBy(*group, key).agg(F.min(F.struct(*order)).alias("o")).select(g, "o", key))
    first = cut(least.sort("g", "o").withColumn("k", F.monotonically_increasing_id()))
    seen = first.agg(F.count(F.lit(1)).alias("n"), F.bit_or(key).alias("any"), F.bit_and(key).alias("all")).first()
    bits = [i for i in range(64) if ((seen["any"] or 0) ^ (seen["all"] or 0)) >> i & 1]
    segments, masks, cost = _lookup(seen["n"], most, bits)
    # A lookup goes through a shuffle; a comparison inside a block is some hundred times cheaper.
    if segments and (200 * cost < seen["n"] if by_lookups is None else by_lookups):
        how, rounds = "left_anti", _lost_by_lookups(first.select("k", "g", key), key, most, segments, masks, seen["n"])
    else:
        how, rounds = "left_semi", _kept_by_blocks(first, key, most, block_rows)
    found = first.select("k").limit(0)
    for more in rounds:
        found = found.unionByName(more)
    first = first.join(found, "k", how)  # once: a join for each round would hold buffers for each round in every task
    return first.select(*[f"g.{c}" for c in group], "o.*", key)


def drop_near_hashes_of_any(rows: DataFrame, group: list[str], order: list[str], key: str, most: int, block_rows: int = 20_000) -> DataFrame:
    """As drop_near_hashes; groups of more than block_rows rows, which no task should hold, are settled in rounds. The order must be total."""
    large = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_group")).where(F.col("n_group") > block_rows).select(*group))
    if large.isEmpty():
        return drop_near_hashes(rows, group, order, key, most)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group]
    part = lambda how: rows.alias("r").join(large.alias("g"), on, how).select("r.*")
    names = [*group, *order, key]
    return drop_near_hashes(part("left_anti"), group, order, key, most).select(*names).unionByName(drop_near_hashes_everywhere(part("left_semi"), order, key, most, group, block_rows).select(*names))


class _Diverse:
    """Rows of a group in their order, with what each is worth against what is picked; lazily, since that only goes down."""

    def __init__(self, q: np.ndarray, vecs: list, alpha: float, again: np.ndarray | None = None):
        width = max((len(v) for v in vecs if v is not None), default=0)
        self.table = np.zeros((len(vecs), width))
        for i, v in enumerate(vecs):
            if v is not None:
                self.table[i, : len(v)] = v
        self.q, self.alpha = q, alpha
        self.again = np.zeros(len(q)) if again is None else again.copy()
        self.worth = alpha * q - (1 - alpha) * self.again
        self.seen = np.zeros(len(q), np.int64)
        self.vectors, self.picked = np.zeros((len(q), width)), []

    def next(self) -> tuple[int, float]:
        """The best row, the first of equal ones, and its worth, once that is up to date."""
        while True:
            i = int(np.argmax(self.worth))
            n = len(self.picked)
            if self.seen[i] == n or self.worth[i] == -np.inf:
                return i, float(self.worth[i])
            dots = (self.vectors[self.seen[i] : n] * self.table[i]).sum(axis=1)
            self.again[i] = max(self.again[i], dots.max())
            self.worth[i], self.seen[i] = self.alpha * self.q[i] - (1 - self.alpha) * self.again[i], n

    def pick(self, i: int) -> None:
        self.vectors[len(self.picked)] = self.table[i]
        self.picked.append(i)
        self.worth[i] = -np.inf


def diverse_permutation(rows: DataFrame, group: list[str], alpha: float, block_rows: int = 20_000, head: int = 2048, first: int | None = None) -> DataFrame:
    """Maximal marginal relevance over the whole of each group: group, id and rank (from 0). Columns: id, order, q, vec (or null).

    Ties go to the smaller order, which no two rows of a group share. A task holds a group
    of up to block_rows rows. A larger group is ordered in rounds: its rows lie in parts of
    that size, and one task picks from the `head` rows that are worth most, as long as the
    best of them is worth more than the best row beyond; the parts then take note of what
    was picked. What a row is worth never rises, so nothing beyond could have come first.
    With `first`, a group of more than block_rows rows is left once so many have a rank;
    its other rows, all of which come later, are not returned.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*group, "id"])
    slim = rows.select(*group, "id", "order", F.col("q").cast("double").alias("q"), F.col("vec").cast("array<double>").alias("vec"))

    def walk(own: pa.Table) -> pa.Table:
        own = own.sort_by("order")
        state = _Diverse(own.column("q").to_numpy().astype(float), own.column("vec").to_pylist(), alpha)
        for _ in range(len(own)):
            state.pick(state.next()[0])
        return pa.table([*(own.column(c).take(state.picked) for c in [*group, "id"]), pa.array(range(len(state.picked)), pa.int32())], names=[*group, "id", "rank"])

    large = cut(slim.groupBy(*group).agg(F.count(F.lit(1)).alias("n_group")).where(F.col("n_group") > block_rows))
    if large.isEmpty():
        return slim.groupBy(*group).applyInArrow(walk, f"{kinds}, rank int")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group]
    small = slim.alias("r").join(large.alias("g"), on, "left_anti").groupBy(*group).applyInArrow(walk, f"{kinds}, rank int")
    parts = F.ceil(F.col("n_group") / block_rows).cast("int")
    left = cut(slim.alias("r").join(large.alias("g"), on).select(F.struct(*[f"r.{c}" for c in group]).alias("g"), F.pmod(F.xxhash64("order"), parts).cast("int").alias("part"), parts.alias("parts"), "id", "order", "q", "vec", F.lit(0.0).alias("again")))
    key = "g " + left.schema["g"].dataType.simpleString()
    id_kind, order_kind = (left.schema[c].dataType.simpleString() for c in ("id", "order"))

    def choose(own: pa.Table) -> pa.Table:
        own = own.sort_by("order")
        place = own.column("n").to_numpy()
        beyond = np.flatnonzero(place > head)  # the best row that is not in the head, if any
        inside = own.filter(pa.array(place <= head))
        state = _Diverse(inside.column("q").to_numpy(), inside.column("vec").to_pylist(), alpha, inside.column("again").to_numpy())
        limit = own.column("worth").to_numpy()[beyond[0]] if len(beyond) else -np.inf
        after = own.column("order")[int(beyond[0])].as_py() if len(beyond) else None
        for turn in range(len(inside)):
            i, worth = state.next()
            if turn and (worth < limit or worth == limit and inside.column("order")[i].as_py() > after):
                break
            state.pick(i)
        done = own.column("done")[0].as_py()
        made = inside.take(state.picked)
        return pa.table([*(made.column(c) for c in ("g", "parts", "id", "order", "vec")), pa.array(range(done, done + len(made)), pa.int32())], names=["g", "parts", "id", "order", "vec", "rank"])

    def note(own: pa.Table, new: pa.Table) -> pa.Table:
        if not len(own) or not len(new):
            return own
        vecs, again = own.column("vec").to_pylist(), own.column("again").to_numpy().copy()
        table = _Diverse(again, vecs, alpha).table
        for v in new.column("vec").to_pylist():
            if v is not None:
                width = min(len(v), table.shape[1])
                again = np.maximum(again, (table[:, :width] * np.asarray(v[:width], float)).sum(axis=1))
        gone = pc.is_in(own.column("order"), value_set=new.column("order").combine_chunks())
        return own.set_column(own.column_names.index("again"), "again", pa.array(again)).filter(pc.invert(gone))

    worth = alpha * F.col("q") - (1 - alpha) * F.col("again")
    done, found = large.select(F.struct(*group).alias("g"), F.lit(0).alias("done")), []
    while not left.isEmpty():
        best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("worth"), "order")
        heads = left.withColumn("worth", worth).withColumn("n", F.row_number().over(best("g", "part"))).where(F.col("n") <= head + 1)  # of each part, so that no task sees a group
        heads = heads.withColumn("n", F.row_number().over(best("g"))).where(F.col("n") <= head + 1).join(done, "g")
        picks = cut(heads.groupBy("g").applyInArrow(choose, f"{key}, parts int, id {id_kind}, `order` {order_kind}, vec array<double>, rank int"))
        found.append(picks)
        done = cut(picks.groupBy("g").agg((F.max("rank") + 1).alias("done")))
        if first is not None:
            done = done.where(F.col("done") < first)
            left = left.join(done, "g", "left_semi")
        told = picks.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "order", "vec")
        schema = f"{key}, part int, parts int, id {id_kind}, `order` {order_kind}, q double, vec array<double>, again double"
        left = cut(left.groupBy("g", "part").cogroup(told.groupBy("g", "part")).applyInArrow(note, schema))
    for picks in found:
        small = small.unionByName(picks.select("g.*", "id", "rank"))
    return small


def suppress_boxes(rows: DataFrame, group: list[str], order: list[str], limit: float = 0.45) -> DataFrame:
    """Non-maximum suppression: in each group, in order, keeps a box if it overlaps all kept ones by less than `limit`."""
    packed = F.array_sort(F.collect_list(F.struct(*order, "x1", "y1", "x2", "y2")))
    kept = _kept(packed, lambda k, x: iou(k, x) >= limit)
    return rows.groupBy(*group).agg(kept.alias("kept")).select(*group, F.inline("kept"))


def diverse_order(rows: DataFrame, group: list[str], alpha: float, first: int) -> DataFrame:
    """Maximal marginal relevance: the first `first` rows of each group; columns id, q and vec. Ties go to the smaller id."""
    packed = F.array_sort(F.collect_list(F.struct("id", "q", "vec")))

    def step(state, _):
        picked, left = state["picked"], state["left"]
        worth = lambda x: alpha * x["q"] - (1 - alpha) * F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(picked, lambda p: dot(p["vec"], x["vec"]))), F.lit(0.0)))
        best = F.array_min(F.transform(left, lambda x: F.struct((-worth(x)).alias("w"), x["id"].alias("id"))))["id"]
        part = lambda b: F.struct(F.concat(picked, F.filter(left, lambda x: x["id"] == b)).alias("picked"), F.filter(left, lambda x: x["id"] != b).alias("left"))
        return F.get(F.transform(F.array(best), part), F.lit(0))  # so that best is found once, not for each row

    start = F.struct(F.filter("all", lambda x: F.lit(False)).alias("picked"), F.col("all").alias("left"))
    run = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(first), F.size("all"))), start, step, lambda s: s["picked"])
    return rows.groupBy(*group).agg(packed.alias("all")).select(*group, F.posexplode(F.transform(run, lambda p: p["id"])).alias("rank", "id"))


def spaced(rows: DataFrame, group: list[str], at: str, key: str, gap: int) -> DataFrame:
    """The keys of rows kept when going through a group in order and keeping what lies `gap` or more beyond the last one kept."""
    items = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(key).alias("key"))))
    start = F.array().cast("array<struct<at: bigint, key: bigint>>")
    follow = lambda kept, x: F.when((F.size(kept) == 0) | (x["at"] >= F.element_at(kept, -1)["at"] + gap), F.concat(kept, F.array(x))).otherwise(kept)
    slim = rows.select(*group, F.col(at).cast("bigint").alias(at), F.col(key).cast("bigint").alias(key))
    return slim.groupBy(*group).agg(items.alias("items")).select(F.explode(F.aggregate("items", start, follow)).alias("k")).select(F.col("k.key").alias(key))
