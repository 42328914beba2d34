"""k-means over exact integers with Elkan's bounds.

Each vector carries its cluster, an upper bound of the distance to its own centroid and a
lower bound for each centroid. When centroids move, the bounds move by as much; a distance
is computed only where neither the bounds nor half the distance between two centroids can
exclude the other centroid. Bounds are rounded away from the truth after every step and
exclude strictly, so that ties and results are those of computing every distance: squared
distances that decide are exact integers.

A round reads the vectors and their bounds as written by the last one, and writes the next;
the older table is then deleted. Between rounds the driver holds k centroids, their sums
and counts, nothing else; there is no shuffle but that of k rows of sums from each task.

Cases: rows whose vector is null, has another number of components, or holds a null or
non-finite one, are left out. Ties go to the smaller centroid. Repeated rows are vectors of
their own. A row without vec_id is clustered, and its vector can be a starting centroid
only after all those with one; of rows of one vec_id the least vector comes first. Fewer
than k vectors give as many centroids. An empty table gives an empty result. A component
of 2^17 or more, whose squared distance might not fit a long, is an error. Extra columns
pass through `keep` only; one that bears the name of a result column comes back with
"_input" appended.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, kept_names, local_rows, materialise, table

OWN = ("cluster", "distance", "computed")
#: Relative error of a step in double precision, with room to spare.
ROUND = 1e-12


def _above(x):
    return x * (1 + ROUND)


def _below(x):
    return x * (1 - ROUND)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Bounds:
    """What a round needs besides the vectors: old and new centroids."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.centroids = new
        self.shift = _above(np.sqrt(_above(squared(old, new).astype(float))))
        apart = _below(np.sqrt(_below(squared(new[:, None], new[None]).astype(float)))) / 2
        np.fill_diagonal(apart, np.inf)
        #: Half the distance between centroids: one that is nearer than this to its own is strictly nearer to it than to the other.
        self.half = apart
        self.nearest = apart.min(axis=1, initial=np.inf)


def assign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: np.ndarray, to: Bounds, exact: bool) -> tuple[np.ndarray, ...]:
    """cluster, upper, lower and computed (distances so far) after the centroids moved; exact: also the squared distance to the own centroid."""
    upper = _above(upper + to.shift[cluster])
    lower = np.maximum(_below(lower - to.shift), 0.0)
    cluster, computed = cluster.copy(), computed.copy()
    known = np.full(len(cluster), -1, np.int64)  # the exact squared distance to the own centroid, where computed

    def compute(rows: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        computed[rows] += 1
        return squared(vectors[rows], to.centroids[c])

    def tighten(rows: np.ndarray) -> None:
        rows = rows[known[rows] < 0]
        known[rows] = compute(rows, cluster[rows])
        upper[rows] = _above(np.sqrt(_above(known[rows].astype(float))))
        lower[rows, cluster[rows]] = _below(np.sqrt(_below(known[rows].astype(float))))

    open_ = np.flatnonzero(upper >= to.nearest[cluster])
    for c in range(len(to.centroids)):
        asks = lambda r: r[(cluster[r] != c) & (upper[r] >= lower[r, c]) & (upper[r] >= to.half[cluster[r], c])]  # noqa: B023, E731
        rows = asks(open_)
        tighten(rows)
        rows = asks(rows)
        new = compute(rows, c)
        lower[rows, c] = _below(np.sqrt(_below(new.astype(float))))
        nearer = (new < known[rows]) | (new == known[rows]) & (c < cluster[rows])
        rows, new = rows[nearer], new[nearer]
        cluster[rows], known[rows] = c, new
        upper[rows] = _above(np.sqrt(_above(new.astype(float))))
    if exact:
        tighten(np.arange(len(cluster)))
    return cluster, upper, lower, computed, known


def whole_vectors(rows: DataFrame, keep: list[str], vector: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """k0, k1, ... (the columns of keep) and v: vectors of that size without null or non-finite component, as floor(scale * x)."""
    wide = F.col(vector).cast("array<double>")
    sound = (F.size(wide) == size) & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x) < float(1 << 17), F.floor(x * scale).cast("int")).otherwise(F.raise_error("a component of 2^17 or more: squared distances might not fit a long").cast("int"))
    return rows.where(F.coalesce(sound, F.lit(False))).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.transform(wide, whole).alias("v"))


def starting_centroids(found: DataFrame, id_at: int, k: int, salt: str) -> np.ndarray:
    """The k vectors of smallest SHA-256 of the salt and their id."""
    own = F.sha2(F.concat(F.lit(salt), F.col(f"k{id_at}").cast("string")), 256)
    least = found.select(own.alias("own"), "v").orderBy(F.asc_nulls_last("own"), "v").limit(k).collect()
    return np.array([r["v"] for r in least], np.int64)


def clustered(rows: DataFrame, keep: list[str], id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """keep, cluster, distance (squared) and computed (distances computed for the row) of all sound vectors, and the final centroids."""
    spark = rows.sparkSession
    bounded_batches(spark)
    names = [*keep, id]
    found = materialise(whole_vectors(rows, names, vector, size, scale), "vectors")
    centroids = starting_centroids(found, len(keep), k, salt)
    n_keep, kinds = len(keep), "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(found.schema.fields[: len(keep)]))
    if not len(centroids):
        none = found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, OWN))], F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("computed"))
        return none, []

    def moved(to: Bounds, first: bool, exact: bool):
        many = len(to.centroids)

        def run(batches):
            for batch in batches:
                n = len(batch)
                vectors = batch.column(n_keep).flatten().to_numpy().reshape(n, -1).astype(np.int64)
                if first:
                    state = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, many)), np.zeros(n, np.int64)
                else:
                    cluster, upper, lower, computed = batch.columns[n_keep + 1 : n_keep + 5]
                    state = cluster.to_numpy().astype(np.int64), upper.to_numpy(), lower.flatten().to_numpy().reshape(n, many), computed.to_numpy()
                cluster, upper, lower, computed, known = assign(vectors, *state, to, exact)
                lists = pa.ListArray.from_arrays(np.arange(0, n * many + 1, many, np.int32), lower.ravel())
                more = [pa.array(known)] if exact else [pa.array(upper), lists]
                tail = ["cluster", "distance", "computed"] if exact else ["cluster", "upper", "lower", "computed"]
                yield pa.RecordBatch.from_arrays([*batch.columns[: n_keep + (0 if exact else 1)], pa.array(cluster.astype(np.int32)), *more, pa.array(computed)], [*[f"k{i}" for i in range(n_keep)], *([] if exact else ["v"]), *tail])

        return run

    now, old = found.select(*[f"k{i}" for i in range(n_keep)], "v"), centroids
    stored = found
    for turn in range(rounds):
        new = materialise(now.mapInArrow(moved(Bounds(old, centroids), turn == 0, False), f"{kinds}v array<int>, cluster int, upper double, lower array<double>, computed long"), "bounds")
        discard(stored)
        now = stored = new
        sums = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(size)]).alias("sums")).collect()
        old, centroids = centroids, centroids.copy()
        for r in sums:
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    done = materialise(now.mapInArrow(moved(Bounds(old, centroids), rounds == 0, True), f"{kinds}cluster int, distance long, computed long"), "clusters")
    discard(stored)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, OWN))], *OWN), centroids.tolist()


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"), ["vec_id"])
    digests = [{"c": i, "centroid_sha256": hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()} for i, c in enumerate(centroids)] or [{"c": -1, "centroid_sha256": ""}]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    own = {r["cluster"]: r["cluster_inertia"] for r in inertia}
    told = local_rows(spark, [d | {"cluster_inertia": own.get(d["c"], 0), "inertia": sum(own.values())} for d in digests]).select("c", F.col("cluster_inertia").cast("long"), F.col("inertia").cast("long"), "centroid_sha256")
    return found.join(F.broadcast(told), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Every distance of every round, one common table expression a round."""
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, sha256('3:' || vec_id) AS own, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {size} AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
n AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM k),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY own, v) - 1 AS INTEGER) AS c, v AS w FROM n ORDER BY own, v LIMIT {k})"""]  # fmt: skip
    near = "a{0} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, w)]) AS BIGINT) AS d FROM n, c{0}) GROUP BY r)"
    for t in range(rounds):
        steps.append(near.format(t))
        steps.append(
            f"""s{t} AS MATERIALIZED (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS w FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS m
  FROM (SELECT a.c, unnest(v) AS x, unnest(range({size})) AS i FROM n JOIN a{t} a USING (r)) GROUP BY c, i) GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(s.w, o.w) AS w FROM c{t} o LEFT JOIN s{t} s USING (c))"""
        )
    steps.append(near.format(rounds))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(e.w, ',')) AS centroid_sha256 FROM n JOIN a{rounds} a USING (r) JOIN c{rounds} e ON e.c = a.c"""


ORACLE = {"op13_centroid_clusters": _oracle()}
QUERIES = {"op13_centroid_clusters": op13_centroid_clusters}
