"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments of about as many bits as the logarithm of a block's rows,
16 at most; each block of rows has, for each segment, an index from segment values to
rows. A query looks up its own segment values, then those one bit away, and so on,
segment by segment, and verifies whatever it meets. After radius r in the first s + 1
segments and r - 1 in the others every code within m * r + s bits has been met, so the
search ends once the kth verified distance is no more than that. All lookups of a query
together are at most m times twice the block's rows. Rows and queries meet in blocks, each task returns k rows for each
of its queries, and a window keeps the best k. A row is copied once for each block of
queries and a query once for each block of rows.

Cases: a null or empty vector has no code; it neither asks nor is found. Codes of another
length than the query's are not compared. Equal distances go by the smaller id. A
query does not find its own id, however many rows have it. Queries of one id are one
query, of their smallest code. Other rows that share an id each count as a row, and can
take several places of a list. Fewer than k other rows give fewer results. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, table

WIDEST = 16  # bits of a segment; codes are padded to a multiple of as many


@dataclass(frozen=True)
class Spec:
    k: int = 10
    #: Rows and queries that meet in one task.
    block_rows: int = 65_536
    block_queries: int = 65_536
    #: Whether a block's rows that are left are all met where a lookup would take more values than there are rows; the result is the same.
    may_scan: bool = False


@lru_cache
def masks(width: int, radius: int) -> np.ndarray:
    """The values of `width` bits of which `radius` are set; none if there are not so many."""
    values = np.arange(2**width)
    return values[np.bitwise_count(values) == radius]


def sign_codes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and code: a bit for each coordinate, set if it is positive, padded to whole segments."""

    def run(batches):
        for batch in batches:
            ids, sizes = batch.column(0), pc.list_value_length(batch.column(1))
            for size in pc.unique(sizes.drop_null()).to_pylist():
                own = batch.filter(pc.and_(pc.is_valid(ids), pc.equal(sizes, size)))
                if size and len(own):
                    bits = pc.fill_null(own.column(1).flatten(), 0).to_numpy(zero_copy_only=False).reshape(len(own), size) > 0
                    codes = np.packbits(np.pad(bits, ((0, 0), (0, -size % WIDEST))), axis=1)
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, code binary")


class Index:
    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        """codes: [row, byte]. Segments follow each other; their widths differ by one bit at most."""
        self.ids, self.codes, self.verified = ids, codes, 0
        bits = 8 * codes.shape[1]
        self.cuts = np.array_split(np.arange(bits), -(-bits // min(WIDEST, max(1, len(ids).bit_length()))))
        self.segments = self.values(codes)
        self.order = [np.argsort(s, kind="stable") for s in self.segments]
        self.starts = [np.searchsorted(s[o], np.arange(2 ** len(c) + 1)) for s, o, c in zip(self.segments, self.order, self.cuts)]

    def values(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each segment, its value in each code."""
        bits = np.unpackbits(codes, axis=1)
        return [bits[:, c] @ (1 << np.arange(len(c), dtype=np.int64)) for c in self.cuts]

    def rows(self, segment: int, values: np.ndarray) -> np.ndarray:
        low, high = self.starts[segment][values], self.starts[segment][values + 1]
        full = high > low
        low, size = low[full], (high - low)[full]
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.order[segment][at]

    def nearest(self, own: int, code: np.ndarray, k: int, may_scan: bool) -> list[tuple[int, int]]:
        """(distance, id) of the k nearest other rows, in order."""
        m, seen, best = len(self.cuts), np.zeros(len(self.ids), bool), []
        mine = [int(v[0]) for v in self.values(code[None])]
        for radius in range(1 + max(len(c) for c in self.cuts)):
            whole = may_scan and sum(len(masks(len(c), radius)) for c in self.cuts) >= len(self.ids)  # more values than rows: meet all that is left
            for s, cut in enumerate(self.cuts):
                met = np.flatnonzero(~seen) if whole else self.rows(s, mine[s] ^ masks(len(cut), radius))
                met = met[~seen[met]]  # a lookup meets a row once
                seen[met] = True
                met = met[self.ids[met] != own]  # before the cut below: rows of the query's own id must not take up its places
                self.verified += len(met)
                if len(met):
                    far = np.bitwise_count(self.codes[met] ^ code).sum(axis=1)
                    if len(met) > 4 * k:
                        near = far <= np.partition(far, k - 1)[k - 1]
                        met, far = met[near], far[near]
                    best = sorted([*best, *((int(d), int(i)) for d, i in zip(far, self.ids[met]))])[:k]
                if whole or len(best) == k and best[-1][0] <= m * radius + s:
                    return best
        return best


def top_k(rows: DataFrame, queries: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """query_id, id, distance and rank; rows and queries: id, code."""
    rows, queries = materialise(rows, "codes"), materialise(queries.groupBy("id").agg(F.min("code").alias("code")), "queries")
    parts = [max(1, -(-df.count() // n)) for df, n in ((rows, spec.block_rows), (queries, spec.block_queries))]
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("r", block(parts[0])).withColumn("q", every(parts[1]))
    right = queries.withColumn("q", block(parts[1])).withColumn("r", every(parts[0]))

    def search(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        sizes = {len(c) for c in asked.column("code").to_pylist()} & {len(c) for c in own.column("code").to_pylist()}
        for size in sorted(sizes - {0}):
            pick = lambda t: [(i, c) for i, c in zip(t.column("id").to_pylist(), t.column("code").to_pylist()) if len(c) == size]  # noqa: B023, E731
            held = pick(own)
            index = Index(np.array([i for i, _ in held], np.int64), np.frombuffer(b"".join(c for _, c in held), np.uint8).reshape(len(held), size))
            for i, c in pick(asked):
                found += [(i, n, d) for d, n in index.nearest(i, np.frombuffer(c, np.uint8), spec.k, spec.may_scan)]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "id": pa.array([f[1] for f in found], pa.int64()), "distance": pa.array([f[2] for f in found], pa.int64())})

    met = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(search, "query_id long, id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= spec.k)


def op2_hamming_topk(spark, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = top_k(codes, codes.where("id % 100 = 0"))
    return found.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


ORACLE = {
    "op2_hamming_topk": """
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, CAST(len(list_filter(range(1, len(a) + 1), lambda i: (a[i] > 0) <> (embedding[i] > 0))) AS BIGINT) AS distance
      FROM q JOIN embeddings ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10
"""
}
QUERIES = {"op2_hamming_topk": op2_hamming_topk}
