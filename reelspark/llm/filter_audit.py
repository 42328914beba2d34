"""Audit of how filters interact, by a product of mask histograms and incidence matrices.

A document's mask says which of five filters it fails. For each part of the corpus three
histograms over the 32 masks are stacked as rows: of all documents, of good and of toxic
ones. Integer matrices with a row for each mask and a column for each order of the filters
and step (120 x 5) say what becomes of a mask there: kept, removed, redundant (fails, but
was removed before) or failing this filter only. Their products are the counts.

Filters A to D look at one text; E, the copy filter, compares texts table-wide: texts are
grouped by their digest, with counts summed before the shuffle, so that a text that a third
of all rows share is a handful of rows of counts when its group is settled.

Cases: a null text is empty, a null part is ''. Of labels of one doc_id any 1 counts. A row
without doc_id has no labels and is a copy of nothing, nor does it make others copies;
rows that share a doc_id and a text do not make each other copies. Repeated rows count each.
An empty table gives an empty result, an empty labels table zeros. Other columns are not
read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, let, small_or_none, table

#: The filters; a mask has the bit 1 << i of the i-th.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]


def incidence() -> dict[str, np.ndarray]:
    """Integer matrices of masks by orders and steps."""
    masks = np.arange(1 << len(FILTERS))
    found = {name: np.zeros((len(masks), len(STEPS)), np.int64) for name in ("kept", "removed", "redundant", "unique", "shapley")}
    own = []
    for k, (order, step) in enumerate(STEPS):
        bits = [1 << FILTERS.index(c) for c in order[:step]]
        before, this = sum(bits[:-1]), bits[-1]
        found["kept"][:, k] = masks & (before | this) == 0
        found["removed"][:, k] = (masks & before == 0) & (masks & this != 0)
        found["redundant"][:, k] = (masks & before != 0) & (masks & this != 0)
        found["unique"][:, k] = masks == this
        own.append(this)
    own = np.array(own)
    for bit in set(own.tolist()):
        found["shapley"][:, own == bit] = found["removed"][:, own == bit].sum(axis=1, keepdims=True)
    return found


def text_mask(text: Column) -> Column:
    """The bits of filters A to D for a text that is not null."""

    def judged(words: Column) -> Column:
        n = F.size(words)
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        fails = (n < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), F.rlike(text, F.lit("[#$%&*|]")))
        return sum((F.when(x, F.lit(1 << i)).otherwise(0) for i, x in enumerate(fails)), F.lit(0))

    return let(F.filter(F.split(text, SPACES, -1), lambda w: w != ""), judged)


def histograms(docs: DataFrame, labels: DataFrame, part: str = "lang", broadcast_rows: int = 100_000) -> DataFrame:
    """part, mask, good, toxic and n: counts of documents; one row for each combination that occurs."""
    text = F.coalesce("text", F.lit(""))
    judged = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    slim = judged.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    labelled = slim.join(small_or_none(told, broadcast_rows), F.col("id") == F.col("l_id"), "left").select("id", "part", "digest", "mask", flag("good").alias("good"), flag("toxic").alias("toxic"), "n")
    group = ["part", "mask", "good", "toxic"]
    # Of each text and group: rows, and how many of them bear the least id.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    by_id = labelled.groupBy("digest", *group, "id").agg(F.sum("n").alias("n"))
    met = by_id.groupBy("digest", *group).agg(least, F.sum(F.when(F.col("id").isNotNull(), F.col("n"))).alias("named"), F.sum("n").alias("n"))
    texts = met.groupBy("digest", "mask").agg(F.min("least.id").alias("first"), F.collect_list(F.struct("part", "good", "toxic", "least", "named", "n")).alias("groups"))
    each = texts.select("mask", "first", F.inline("groups"))
    firsts = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = F.coalesce(F.col("named") - firsts, F.lit(0))
    rows = F.explode(F.array(F.struct("mask", (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), copies.alias("n"))))
    return each.select("part", "good", "toxic", rows.alias("r")).where("r.n > 0").groupBy("part", "r.mask", "good", "toxic").agg(F.sum("r.n").alias("n"))


def audited(counts: DataFrame) -> DataFrame:
    """The counts of every part, order and step, from histograms as above."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("held"))  # 128 at most
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def multiply(batches):
        of = incidence()
        orders, steps = pa.array([o for o, _ in STEPS]), pa.array([s for _, s in STEPS], pa.int32())
        for batch in batches:
            stacked = np.zeros((3, len(batch), 1 << len(FILTERS)), np.int64)
            for i, rows in enumerate(batch.column(1).to_pylist()):
                for r in rows:
                    stacked[:, i, r["mask"]] += np.array([1, r["good"], r["toxic"]]) * r["n"]
            every, good, toxic = stacked
            for i, part in enumerate(batch.column(0).to_pylist()):
                products = [every[i] @ of["kept"], every[i] @ of["removed"], every[i] @ of["redundant"], every[i] @ of["unique"], good[i] @ of["removed"], toxic[i] @ of["removed"], every[i] @ of["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(STEPS)), orders, steps, *map(pa.array, products)], ["part", "filter_order", "step", *names])

    return held.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audited(histograms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = {
    "op11_filter_audit": r"""
WITH w AS (SELECT *, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM w),
d AS (SELECT doc_id, coalesce(lang, '') AS part,
  (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM x),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x FROM d LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
m AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(k)),
a AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM h, m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""
}
QUERIES = {"op11_filter_audit": op11_filter_audit}
