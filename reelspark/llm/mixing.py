"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are put in a fixed random order and cut into blocks. Block j of a
source of weight w has release time floor(j / w) and deadline ceil((j + 1) / w); in
every slot the released block of earliest deadline goes next. So after any number of
slots each source has had its weight's share to within less than one block. When a
source is used up, a new phase begins with the other sources' weights scaled up, so
every row gets a place.

Weights are rounded to whole shares of `period` slots, in which the schedule repeats;
only one period of each phase is simulated, from the sources' row counts alone. What
that plan holds is the number of sources times the period, whatever the data's size.

Ranks inside a source come from counts of hash ranges, so a source that holds a third
of all rows is ranked by many tasks.

Cases: a null source is a source of its own. Sources without a given weight count as
weight 0 and follow at the end, in one last phase. Equal rows share their order key
and are interchangeable. An empty table gives an empty result. Columns of the input
pass through; mix() appends "_input" to the name of one that bears the name of a result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept_names, materialise, small_or_none, table

NO_SOURCE = "\x00"
OWN = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


@dataclass(frozen=True)
class Spec:
    block_rows: int = 16
    period: int = 2000
    #: Rows of a hash range, which one task ranks.
    range_rows: int = 20_000
    #: Rows of a run, which one task puts in order.
    run_rows: int = 5_000
    #: Most bytes of a schedule that is broadcast; a larger one is joined by shuffle.
    broadcast_bytes: int = 32_000_000
    seed: int = 17


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period, at least 1 each, that add up to it; largest remainders are rounded up."""
    total, spare = sum(weights.values()), period - len(weights)
    exact = {k: spare * w / total for k, w in weights.items()}
    found = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: (int(exact[k]) - exact[k], k))[: period - sum(found.values())]:
        found[k] += 1
    return found


def one_period(share: dict[str, int], period: int) -> dict[str, list[int]]:
    """The slots of every source's blocks in a period: of the released blocks the earliest deadline goes first."""
    slots: dict[str, list[int]] = {k: [] for k in share}
    waiting = [(0, -(-period // q), k) for k, q in share.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, deadline, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k))
        _, k = heapq.heappop(ready)
        slots[k].append(t)
        if (j := len(slots[k])) < share[k]:
            heapq.heappush(waiting, (j * period // share[k], -(-(j + 1) * period // share[k]), k))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, float], period: int) -> dict[str, list[dict]]:
    """For each source its phases: first block, first slot, period and the slots of its blocks in a period."""
    left = {k: n for k, n in blocks.items() if n}
    taken, start, found = dict.fromkeys(left, 0), 0, {k: [] for k in left}
    while left:
        active = {k: weights.get(k, 0.0) for k in left if weights.get(k, 0.0) > 0} or dict.fromkeys(left, 1.0)
        length = max(period, 4 * len(active))
        share = shares(active, length)
        slots = one_period(share, length)
        last = lambda k: (left[k] - 1) // share[k] * length + slots[k][(left[k] - 1) % share[k]]  # noqa: B023, E731
        end = min(last(k) for k in active)
        for k in active:
            found[k].append({"first_block": taken[k], "first_slot": start, "period": length, "slots": slots[k]})
            cycles, rest = divmod(end, length)
            done = cycles * share[k] + sum(s <= rest for s in slots[k])
            taken[k] += done
            left[k] -= done
        left = {k: n for k, n in left.items() if n > 0}
        start += end + 1
    return found


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of the sources' sizes: small sources get more than their share."""
    return {k: float(n) ** power for k, n in counts.items()}


class Mix:
    """A mix of rows: the order inside each source and the schedule of the sources' blocks.

    identity: columns whose hash orders a source's rows. weights: by source, or a function of
    the sources' row counts that gives them (a null source is "\\x00").
    """

    def __init__(self, rows: DataFrame, identity: list[str], source: str, weights, spec: Spec):
        spark, self.spec, self.columns = rows.sparkSession, spec, [f"c{i}" for i in range(len(rows.columns))]
        of = dict(zip(rows.columns, self.columns))
        identity, source, rows = [of[c] for c in identity], of[source], rows.toDF(*self.columns)
        named = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
        thin = rows.select(named.alias("mix_source"), F.xxhash64(F.lit(spec.seed), *identity).alias("mix_key"))
        counted = thin.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each source
        counts = {r["mix_source"]: r["n"] for r in counted}
        given = weights(counts) if callable(weights) else weights
        planned = plan({k: -(-n // spec.block_rows) for k, n in counts.items()}, given, spec.period)
        self.ranges = -(-sum(counts.values()) // spec.range_rows) or 1
        self.thin = self.keyed(thin)
        sizes = self.thin.groupBy("mix_source", "mix_range").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = materialise(sizes.select("mix_source", "mix_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before")), "mix-ranges")
        phases = "array<struct<first_block:long,first_slot:long,period:long,slots:array<long>>>"
        known = spark.createDataFrame(pd.DataFrame({"mix_source": list(planned), "p": list(planned.values())}, dtype=object), f"mix_source string, p {phases}")
        held = sum(len(f["slots"]) + 4 for found in planned.values() for f in found) * 8
        self.known = F.broadcast(known) if held <= spec.broadcast_bytes else known
        self.rows, self.identity, self.named = rows, identity, named

    def keyed(self, thin: DataFrame) -> DataFrame:
        return thin.withColumn("mix_range", F.pmod(F.shiftrightunsigned("mix_key", 32), F.lit(self.ranges).cast("long")))

    def whole(self) -> DataFrame:
        return self.keyed(self.rows.withColumns({"mix_source": self.named, "mix_key": F.xxhash64(F.lit(self.spec.seed), *self.identity)}))

    def ranked(self, keyed: DataFrame, order: list[str]) -> DataFrame:
        """keyed with mix_position, counted inside the source."""
        rank = F.row_number().over(Window.partitionBy("mix_source", "mix_range").orderBy("mix_key", *order))
        found = keyed.withColumn("mix_rank", rank).join(small_or_none(self.offsets, 10_000), ["mix_source", "mix_range"])
        return found.withColumn("mix_position", F.col("mix_before") + F.col("mix_rank") - 1)

    def placed(self, ranked: DataFrame, keep: list[str]) -> DataFrame:
        """keep and the places in the mix of rows with mix_source and mix_position."""
        position = F.col("mix_position")
        blocks = ranked.withColumn("mix_block", F.floor(position / self.spec.block_rows)).withColumn("mix_place", F.pmod(position, F.lit(self.spec.block_rows)).cast("int"))
        found = blocks.join(self.known, "mix_source").withColumn("mix_phase", F.element_at(F.filter("p", lambda x: x["first_block"] <= F.col("mix_block")), -1))
        phase, step = F.col("mix_phase"), F.col("mix_block") - F.col("mix_phase.first_block")
        share = F.size(phase["slots"]).cast("long")
        base, k = phase["first_slot"] + F.floor(step / share) * phase["period"], F.pmod(step, share)
        return found.select(
            *keep, "mix_block",
            (base + F.floor(k * phase["period"] / share)).alias("mix_release"), (base + F.ceil((k + 1) * phase["period"] / share)).alias("mix_deadline"),
            (base + F.get(phase["slots"], k.cast("int"))).alias("mix_slot"), "mix_place",
        )


def mix(rows: DataFrame, identity: list[str], source: str = "source", weights=tempered, spec: Spec = Spec()) -> DataFrame:
    """rows with mix_block, mix_release, mix_deadline, mix_slot and mix_place (in the block)."""
    own = Mix(rows, identity, source, weights, spec)
    return own.placed(own.ranked(own.whole(), own.identity), own.columns).toDF(*kept_names(rows.columns, OWN), *OWN)


def arranged(rows: DataFrame, identity: list[str], source: str = "source", weights=tempered, spec: Spec = Spec()) -> DataFrame:
    """rows in the order of the mix: a run is run_rows rows' worth of slots, a partition holds whole runs, each in order.

    Only sources and hashes are ranked at first; that tells at which hashes a source's rows
    pass from one run to the next. Then the rows themselves are shuffled once, by run.
    Rows of equal hash stay in one run, that of the first of them.
    """
    own = Mix(rows, identity, source, weights, spec)
    first = own.ranked(own.thin, []).groupBy("mix_source", "mix_range", "mix_key").agg(F.min("mix_position").alias("mix_position"))
    run = F.floor(F.col("mix_slot") * spec.block_rows / spec.run_rows)
    places = own.placed(first.withColumn("mix_at", F.col("mix_position")), ["mix_source", "mix_range", "mix_key", "mix_at"]).withColumn("mix_run", run)
    cuts = places.groupBy("mix_source", "mix_range", "mix_run").agg(F.min(F.struct("mix_key", "mix_at")).alias("low"))
    cuts = cuts.groupBy("mix_source", "mix_range").agg(F.array_sort(F.collect_list(F.struct(F.col("low.mix_key").alias("key"), F.col("low.mix_at").alias("at"), F.col("mix_run").alias("run")))).alias("cuts"))  # a range has about range_rows rows
    cuts = materialise(cuts, "mix-runs")
    met = own.whole().join(small_or_none(cuts, 10_000), ["mix_source", "mix_range"]).withColumn("cut", F.element_at(F.filter("cuts", lambda c: c["key"] <= F.col("mix_key")), -1))
    dealt = met.select(*own.columns, "mix_source", "mix_range", "mix_key", F.col("cut.run").alias("mix_run"), F.col("cut.at").alias("mix_at")).repartition("mix_run")
    rank = F.row_number().over(Window.partitionBy("mix_run", "mix_source", "mix_range").orderBy("mix_key", *own.identity))
    placed = own.placed(dealt.withColumn("mix_position", F.col("mix_at") + rank - 1), [*own.columns, "mix_run"])
    return placed.sortWithinPartitions("mix_run", "mix_slot", "mix_place").select(*own.columns).toDF(*rows.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mix(docs, ["doc_id", "text_hash"]).select(
        "doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_release").alias("release"), F.col("mix_deadline").alias("deadline"), F.col("mix_slot").alias("slot"), F.col("mix_place").alias("place")
    )


QUERIES = {"op1_mixing": op1_mixing}
