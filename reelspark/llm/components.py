"""Connected components by alternating large-star and small-star rounds; edges stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node on an edge (a, b); the root is the smallest node that can be reached. Roots themselves have no row."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        now = materialise(_small_star(_large_star(now).distinct()), "components")
        ends = now.select(F.col("a").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("b").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("u").agg(F.sum("below").alias("n"), F.max("above").alias("above")).where("n > 1 OR (n = 1 AND above = 1)").isEmpty():  # only stars are left
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
