"""The whole of curation: gate, scenes, near copies, order inside scenes, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..operators import greedy, scenes, selection
from ..operators.lineage import cut
from .catalogue import DOT, query
from .parameters import Parameters


def candidates(vecs: DataFrame) -> DataFrame:
    """Items with all that curation reads, one for each vector; the columns beyond the vectors are made up from the id."""
    i = F.col("id")
    return vecs.select(
        F.lit("all").alias("pool"), "id", F.concat(F.lit("f"), F.lpad(i.cast("string"), 8, "0"), F.lit(".jpg")).alias("path"), F.floor(i * 7 / 3).cast("double").alias("ts"),
        ((i * 53 % 100) / 180.0).alias("face_fd"), ((i * 29 % 100) / 100.0).alias("sharpness"), ((i * 17 % 50) / 50.0).alias("exposure"), ((i * 11 % 1300) * 1.0).alias("face_quality"),
        ((i * 7 % 60) / 100.0).alias("face_frac"), F.element_at(F.array(*[F.lit(float(w)) for w in (400, 450, 400, 600, 900, 450, 1200)]), (i % 7 + 1).cast("int")).alias("w"), F.lit(600.0).alias("h"),
        ((i * 31 % 140) - 70).cast("double").alias("yaw"), ((i % 13) / 26.0).alias("wmark"), ((i % 17) / 50.0).alias("border"), vectors.sign_hash("embedding").alias("hash"),
        F.when(i % 9 != 0, F.slice("embedding", 1, 32)).alias("clip"), F.when(i % 5 != 0, F.slice("embedding", 33, 32)).alias("feat"),
    )


def _independent(whole: DataFrame, ranked: DataFrame, picked: DataFrame, most_bits: int, block_rows: int) -> bool:
    """Whether the picks are those of the whole order, of which ranked may hold only the beginning of large scenes.

    They are if, for each list (scene, category, profile flag) of rows without a rank, a row with one that could stand in for
    all of it was still to be had at the end, and so at each pick: it is of the scene and category, no profile unless they are,
    and no near copy of a pick. It comes before them, so none of them was ever the first row that its scene could offer.
    """
    key, slim = ["pool", "scene"], ["pool", "scene", "id", "category", "is_profile", "hash"]
    large = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select(*key)
    rows = whole.select(*slim[:4], F.coalesce("is_profile", F.lit(False)).alias("is_profile"), "hash").join(large, key, "left_semi")
    behind = cut(rows.join(ranked, [*key, "id"], "left_anti").groupBy(*key, "category", "is_profile").agg(F.count(F.lit(1)).alias("n")))
    if behind.isEmpty():
        return True
    near = F.broadcast(picked.select("pool", "id").join(whole.select("pool", "id", "hash"), ["pool", "id"]).select(F.col("pool").alias("p_pool"), F.col("hash").alias("p_hash")))
    there = rows.join(ranked, [*key, "id"], "left_semi")
    left = there.join(near, F.col("pool").eqNullSafe(F.col("p_pool")) & (vectors.hamming(F.col("hash"), F.col("p_hash")) <= most_bits), "left_anti")  # a pick is near itself
    left = cut(left.groupBy(*key, "category").agg(F.bool_and("is_profile").alias("only_profiles"))).toDF("l_pool", "l_scene", "l_category", "only_profiles")
    same = F.col("pool").eqNullSafe(F.col("l_pool")) & (F.col("scene") == F.col("l_scene")) & F.col("category").eqNullSafe(F.col("l_category"))
    return behind.join(left, same & (F.col("is_profile") | ~F.col("only_profiles")), "left_anti").isEmpty()


def curated(items: DataFrame, given: Parameters = Parameters(), block_rows: int = 20_000, first: int = 1024) -> DataFrame:
    """The pick log of each pool: rank, id, path, scene, category, quality, redundancy, score and is_profile.

    Steps: gate by identity and sharpness, sequential scenes, near copies dropped inside
    scenes (of all rows of a pool if not scene_aware), diversity order inside scenes, then
    quotas. Each step deals a pool or a scene that is too large for a task to many.
    Without scene_aware a pool is one scene, number -1. Ids are one for each row of a pool.
    Of scenes of more than block_rows rows the diversity order is made as far as the
    quotas read it: its first rows, four times as many until no pick depends on the rest.
    """
    gated = items.where((F.col("face_fd") <= given.fd_max) & (F.col("sharpness") >= given.sharp_min))
    ratio = scores.ratio_class(F.col("w"), F.col("h"))
    scored = cut(gated.withColumns({
        "q": scores.quality(*[F.col(c) for c in ("face_fd", "sharpness", "exposure", "face_quality", "wmark", "border")]),
        "category": scores.category(ratio, F.col("face_frac")), "is_profile": F.abs("yaw") >= given.profile_yaw,
    }))
    if given.scene_aware:
        found = scenes.cluster_scenes(scored, "pool", given.scene_similarity, given.most_bits, given.scene_gap, given.scene_window)
        placed = cut(scored.join(found, ["pool", "id"]).withColumn("minus_q", -F.col("q")))
    else:
        placed = scored.withColumns({"scene": F.lit(-1), "minus_q": -F.col("q")})
    order = ["minus_q", "face_fd", "ts", "path", "id"]
    kept = greedy.drop_near_hashes_of_any(placed, ["pool", "scene"], order, "hash", given.scene_bits if given.scene_aware else given.most_bits, block_rows)
    whole = placed.join(kept.select("pool", "scene", "id"), ["pool", "scene", "id"])
    whole = whole.withColumns({"vec": vectors.mixed(F.col("clip"), F.col("feat"), given.ground_weight, given.face_weight), "order": F.row_number().over(Window.partitionBy("pool", "scene").orderBy(*order)), "shown": F.col("q")})
    whole = whole.withColumn("q", scores.boosted(scores.clamp(F.col("q"), 0.0, 1.0), F.col("face_frac"), given.closeup_boost, given.closeup_from))
    whole = cut(whole)
    first = max(first, given.most)
    while True:
        ranked = cut(greedy.diverse_permutation(whole, ["pool", "scene"], given.alpha, block_rows, first=first))
        ready = whole.select("pool", "scene", "id", "category", "is_profile", "q", "hash", "vec").join(ranked.withColumnRenamed("rank", "place"), ["pool", "scene", "id"])
        picked = cut(selection.select_by_quota(ready, "pool", given.quotas(), block_rows))
        if _independent(whole, ranked, picked, given.most_bits, block_rows):
            break
        first *= 4
    return picked.join(scored.select("pool", "id", "path", "is_profile"), ["pool", "id"])


@query(on="v_vec")
def curate_flow_plain(vecs):
    """Curation without scenes: near copies dropped over the whole pool, then one diversity order; the tests hold every column against loops."""
    found = curated(candidates(vecs), Parameters(scene_aware=False, most_bits=16))
    return found.select("pool", "rank", "id", "path", "scene", "category", "is_profile", *[F.round(c, 6).alias(c) for c in ("quality", "redundancy", "score")])


@query(on="v_vec")
def curate_flow(vecs):
    """Curation end to end; the tests hold every column against loops."""
    found = curated(candidates(vecs), Parameters(scene_similarity=0.3, most_bits=12, scene_bits=16))
    return found.select("pool", "rank", "id", "path", "scene", "category", "is_profile", *[F.round(c, 6).alias(c) for c in ("quality", "redundancy", "score")])


@query(
    f"""WITH RECURSIVE g AS MATERIALIZED (SELECT a.scene_hint, a.id AS x, b.id AS y, {DOT} AS sim FROM v_vec a JOIN v_vec b ON a.scene_hint = b.scene_hint AND a.id <> b.id),
w AS (SELECT scene_hint, 0::BIGINT AS n, []::BIGINT[] AS picked FROM v_vec GROUP BY scene_hint
  UNION ALL SELECT scene_hint, n + 1, list_append(picked, id) FROM (
    SELECT w.scene_hint, w.n, w.picked, o.id, row_number() OVER (PARTITION BY w.scene_hint ORDER BY 0.75e0 * o.q - 0.25e0 * greatest(0e0, coalesce((SELECT max(sim) FROM g WHERE g.x = o.id AND list_contains(w.picked, g.y)), 0e0)) DESC, o.id) AS k
    FROM w JOIN v_vec o ON o.scene_hint = w.scene_hint AND NOT list_contains(w.picked, o.id)) WHERE k = 1)
SELECT scene_hint, unnest(picked) AS id, CAST(unnest(range(len(picked))) AS INTEGER) AS rank FROM w WHERE n = (SELECT count(*) FROM v_vec v WHERE v.scene_hint = w.scene_hint)""",
    "v_vec",
)
def mmr_full(vecs):
    """The diversity order of whole scenes."""
    rows = vecs.select("scene_hint", "id", F.col("id").alias("order"), "q", F.col("embedding").alias("vec"))
    return greedy.diverse_permutation(rows, ["scene_hint"], 0.75).select("scene_hint", "id", "rank")
