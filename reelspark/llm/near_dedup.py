"""Near-duplicate documents: fast similarity sketches, banding and exact verification.

Sketch (rounds of hashed bin placement): in each round every shingle of a set falls
into one of t bins with a value; a bin keeps the least value of the first round that
reached it. After t rounds of free placement one more round for each bin that is
still empty sends all shingles there, so every coordinate is filled; values of one
coordinate are equal with probability J for two sets of similarity J, with
concentration bounds like independent permutations but in time |set| + t log t.

Links are found among classes of equal sets. Band buckets are walked in order of set
size: each member meets its bucket's first and the `lags` before it, which settles
all pairs of small buckets; large buckets are dealt into pieces, which are walked by
many tasks and tied by the bucket's first. In larger ones that hold several components the most
linked members are held against all others. What is still open is settled between
blocks of members, whose sets meet as matrices in a task; so no bucket emits all
pairs, and no link is lost. Every link is confirmed on full sets; components follow
by star rounds, and pairs inside one component need no more looking at.

With 48 bands of 6 coordinates a pair of similarity 0.8 shares no bucket with
probability 0.738^48 = 5e-7, and less above; groups are tied by many such pairs. Sets
hold 64-bit hashes of shingles; two different shingles of a pair of documents are
mixed up with a probability below 1e-12.

Cases: null and empty texts have no shingles and are linked with nothing. Fewer
words than a shingle needs make one shingle of all. Rows that share a doc_id are one
node. A null doc_id is linked with nothing, has a null component and is kept. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, materialise, small_or_none, table


@dataclass(frozen=True)
class Spec:
    shingle: int = 5
    #: Least similarity in percent.
    percent: int = 80
    bands: int = 48
    rows: int = 6
    lags: int = 4
    #: Members of a large bucket, most linked first, that are held against all of it.
    leaders: int = 4
    #: Members of a bucket that one task walks; a larger bucket is dealt into pieces.
    piece: int = 1024
    #: Most documents whose keys are broadcast to fetch their texts; more are joined by shuffle.
    broadcast_rows: int = 1_000_000
    #: Members of a block, if buckets stay open after that.
    block: int = 256

    @property
    def bins(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """Hashes of words; it forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of runs of `size` words, ascending; of all words if there are fewer."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(own):
        return own
    size = min(size, len(own))
    total = np.full(len(own) - size + 1, size, np.uint64)
    for j in range(size):
        total = mixed(total * _ODD + own[j : len(own) - size + 1 + j])
    return np.unique(total)


def sketch(own: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a set of hashes, one value for each bin."""
    empty, low = np.uint64(2**64 - 1), np.uint64(2**48 - 1)
    found, at = np.full(bins, empty), 0
    while at < bins:
        some = np.arange(at, min(bins, at + max(1, 2 * bins // len(own))), dtype=np.uint64)
        z = mixed(own[None, :] + (some[:, None] + np.uint64(1)) * _ODD)
        np.minimum.at(found, ((z >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64).ravel(), ((some[:, None] << np.uint64(48)) | (z & low)).ravel())
        at += len(some)
        if (found != empty).all():
            return found
    for b in np.flatnonzero(found == empty):
        k = np.uint64(bins + b)
        found[b] = (mixed(own + (k + np.uint64(1)) * _ODD) & low).min() | k << np.uint64(48)
    return found


def bucket_keys(own: np.ndarray, spec: Spec) -> np.ndarray:
    grid, total = sketch(own, spec.bins).reshape(spec.bands, spec.rows), np.arange(spec.bands, dtype=np.uint64)
    for j in range(spec.rows):
        total = mixed(total * _ODD + grid[:, j])
    return total


def lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), pa.array(flat))


def signatures(docs: DataFrame, spec: Spec) -> DataFrame:
    """id, n (shingles), k1 and k2 (a 128-bit hash of the set) and the keys of its buckets."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingles(t, spec.shingle) for t in batch.column(1).to_pylist()]
                whole = [np.array([[mixed(s).sum()], [mixed(s + _ODD).sum()]], np.uint64).view(np.int64) for s in sets]
                columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([int(w[i, 0]) for w in whole], pa.int64()) for i in (0, 1)], lists([bucket_keys(s, spec) if len(s) else s for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "keys"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, keys array<long>")


def shingle_sets(docs: DataFrame, spec: Spec) -> DataFrame:
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists([shingles(t, spec.shingle) for t in batch.column(1).to_pylist()])], ["id", "own"])

    return docs.mapInArrow(run, "id long, own array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("id").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    both = pairs.distinct().join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("own_a", "own_b")).cast("long")
    similar = common * 100 >= (F.size("own_a") + F.size("own_b") - common) * spec.percent
    return materialise(both.where(similar).select("a", "b").distinct(), "links")


def _close(a, b, spec: Spec):
    return F.least(a, b) * 100 >= F.greatest(a, b) * spec.percent


def links(reps: DataFrame, docs: DataFrame, spec: Spec) -> DataFrame:
    """Edges (a, b) that join the classes as their confirmed links do; reps: rep, n, keys."""
    rows = reps.select("rep", "n", F.explode("keys").alias("key"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "rep")).alias("first")).where("size > 1")
    piece = F.when(F.col("size") > spec.piece, F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / spec.piece))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(held, "key").withColumn("piece", piece)
    order = Window.partitionBy("key", "piece").orderBy("n", "rep")
    met = [F.struct(F.lag("rep", k).over(order).alias("rep"), F.lag("n", k).over(order).alias("n")) for k in range(1, spec.lags + 1)]
    walked = dealt.withColumn("met", F.array(*met, F.struct("first.rep", "first.n")))
    walked = materialise(walked.select("key", "rep", "n", "size", F.filter("met", lambda m: m["rep"].isNotNull() & (m["rep"] != F.col("rep")) & _close(m["n"], F.col("n"), spec)).alias("met")), "buckets")
    pairs = walked.select("rep", F.explode("met.rep").alias("other")).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    asked = walked.where((F.size("met") > 0) | (F.col("size") > spec.lags + 1)).select(F.explode(F.concat("met.rep", F.array("rep"))).alias("id"))
    asked = materialise(asked.distinct(), "asked")
    sets = materialise(shingle_sets(docs.join(small_or_none(asked, spec.broadcast_rows), "id", "left_semi"), spec), "sets")
    found = confirmed(pairs, sets, spec)
    degrees = materialise(found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    large = walked.where(F.col("size") > spec.lags + 1).select("key", "rep", "n").join(degrees, "rep", "left").na.fill(0, ["degree"])
    found, members = still_open(found, large)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), F.xxhash64("rep"), "rep"))
    ahead = members.withColumn("place", place).where(F.col("place") <= spec.leaders).groupBy("key").agg(F.collect_list(F.struct("rep", "n", "root", "place")).alias("ahead"))  # each task keeps `leaders` of a bucket
    met = materialise(members.join(ahead, "key").withColumn("own", F.get(F.filter("ahead", lambda m: m["rep"] == F.col("rep")), F.lit(0))["place"]), "led")
    pairs = met.select("rep", F.explode(F.filter("ahead", lambda m: (F.col("own").isNull() | (m["place"] < F.col("own"))) & (m["root"] != F.col("root")) & _close(m["n"], F.col("n"), spec))["rep"]).alias("other"))
    found = found.unionByName(confirmed(pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")), sets, spec))
    found, members = still_open(found, met.where("own IS NULL").select("key", "rep", "n", "degree"))
    return found if members.isEmpty() else found.unionByName(between_blocks(members, sets, spec))


def still_open(found: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links so far as stars, and the members of buckets that hold several components, with root."""
    stars = components(found).select(F.col("node").alias("rep"), "root")
    members = large.join(stars, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return stars.select(F.col("rep").alias("a"), F.col("root").alias("b")), materialise(members.join(split, "key", "left_semi"), "large")


def between_blocks(members: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """Links between members of buckets that are still open, as far as they join different components.

    Buckets that share members form a family. Its members, in order of component and
    size, are dealt into blocks, and a task holds two blocks against each other as
    incidence matrices; it returns links that join components, fewer than it has
    members. Blocks of one component, or too unlike in size, do not meet.
    """
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"))
    family = components(members.join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    who = members.select("rep", "n", "root").distinct().join(family.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    who = who.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("family", "root")))
    order = Window.partitionBy("family").orderBy(F.desc("many"), "root", "n", "rep")
    who = materialise(who.withColumn("block", F.floor((F.row_number().over(order) - 1) / spec.block)), "blocks")
    ends = who.groupBy("family", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    a, b = ends.select("family", *[F.col(c).alias(f"{c}_a") for c in ends.columns[1:]]), ends.select("family", *[F.col(c).alias(f"{c}_b") for c in ends.columns[1:]])
    near = (F.col("hi_a") * 100 >= F.col("lo_b") * spec.percent) & (F.col("hi_b") * 100 >= F.col("lo_a") * spec.percent)
    one = (F.col("r1_a") == F.col("r2_a")) & (F.col("r1_b") == F.col("r2_b")) & (F.col("r1_a") == F.col("r1_b"))
    meetings = materialise(a.join(b, "family").where((F.col("block_a") <= F.col("block_b")) & near & ~one).select("family", "block_a", "block_b"), "meetings")
    held = who.join(sets, F.col("rep") == F.col("id")).select("family", "block", "rep", "root", "own")
    left = held.join(meetings.withColumn("block", F.col("block_a")), ["family", "block"]).withColumn("side", F.lit(0))
    right = held.join(meetings.where("block_a <> block_b").withColumn("block", F.col("block_b")), ["family", "block"]).withColumn("side", F.lit(1))

    def compare(met: pa.Table) -> pa.Table:
        rep, root, side = (met.column(c).to_numpy() for c in ("rep", "root", "side"))
        own = met.column("own").combine_chunks()
        size = np.diff(own.offsets.to_numpy())
        _, words = np.unique(own.flatten().to_numpy(), return_inverse=True)
        at = np.repeat(np.arange(len(rep)), size)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        common = np.zeros((len(first), len(second)), np.float32)
        for begin in range(0, int(words.max(initial=-1)) + 1, 8192):  # exact: counts stay below 2**24
            part = (words >= begin) & (words < begin + 8192)
            seen = np.zeros((len(rep), 8192), np.float32)
            seen[at[part], words[part] - begin] = 1
            common += seen[first] @ seen[second].T
        alike = common * 100 >= (size[first][:, None] + size[second][None, :] - common) * spec.percent
        above = {r: r for r in np.unique(root).tolist()}

        def top(r: int) -> int:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        found = []
        for i, j in zip(*np.nonzero(alike)):
            x, y = top(int(root[first[i]])), top(int(root[second[j]]))
            if x != y:
                above[max(x, y)] = min(x, y)
                found.append((int(rep[first[i]]), int(rep[second[j]])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return materialise(left.unionByName(right).groupBy("family", "block_a", "block_b").applyInArrow(compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, spec: Spec = Spec(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id for every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    signed = materialise(signatures(docs, spec), "signatures")
    usable = signed.where("n > 0 AND id IS NOT NULL")
    reps = materialise(usable.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "classes")
    classes = reps.select("k1", "k2", "n", "rep")
    ranked = signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    ranked = materialise(ranked, "members")
    same_id = ranked.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("a", "b")
    roots = components(links(reps, docs.where("id IS NOT NULL"), spec).unionByName(same_id))
    return ranked.join(roots, F.col("rep") == F.col("node"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Spec(shingle=4))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = {
    "op6_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3])) END AS own FROM d),
c AS (SELECT own, min(doc_id) AS rep, len(own) AS n FROM (SELECT doc_id, list_sort(own) AS own FROM s WHERE len(own) > 0) GROUP BY own),
m AS (SELECT s.doc_id, len(s.own) AS n, coalesce(c.rep, s.doc_id) AS rep FROM s LEFT JOIN c ON list_sort(s.own) = c.own),
x AS (SELECT rep, n, unnest(own) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(k.root, m.rep) AS component_id, m.doc_id = coalesce(k.root, m.rep) AS kept
FROM m LEFT JOIN k ON m.rep = k.node
"""
}
QUERIES = {"op6_near_dedup": op6_near_dedup}
