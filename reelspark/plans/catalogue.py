"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, geometry, scores, vectors
from ..operators import greedy, pairs, scenes, selection
from .bridge import view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, on: str = "v_item"):
    """Registers a function from the view to a result, with the SQL that it must equal."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, on))
        if sql:
            ORACLE[f.__name__] = with_views(sql.strip())
        return f

    return add


#: Six decimals by the same floating-point steps in both engines; their own round() differ at halves.
FIXED = "floor(({}) * 1e6 + 0.5e0) / 1e6"


def _fixed(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


Q = FIXED.format("greatest(0e0, least(1e0, (0.45e0 * greatest(0e0, least(1e0, 1 - greatest(0e0, face_fd) / 0.5e0)) + 0.30e0 * sharpness + 0.20e0 * exposure + 0.05e0 * least(1e0, face_quality / 1200e0)) * greatest(0e0, 1 - 0.6e0 * wmark)))")
RATIO = "CASE WHEN w / h BETWEEN 0.60e0 AND 0.70e0 THEN '2:3' WHEN w / h > 0.70e0 AND w / h <= 0.82e0 THEN '3:4' WHEN w / h BETWEEN 0.95e0 AND 1.05e0 THEN '1:1' WHEN w / h BETWEEN 1.40e0 AND 1.70e0 THEN '3:2' WHEN w / h < 0.60e0 THEN 'narrow' WHEN w / h > 1.70e0 THEN 'wide' ELSE 'other' END"
CATEGORY = f"CASE WHEN {RATIO} IN ('2:3', '3:4') THEN CASE WHEN face_frac >= 0.33e0 THEN 'closeup' WHEN face_frac >= 0.22e0 THEN 'portrait' WHEN face_frac >= 0.12e0 THEN 'cowboy' ELSE 'full' END WHEN {RATIO} IN ('3:2', 'wide') THEN CASE WHEN face_frac >= 0.30e0 THEN 'closeup' ELSE 'wide' END WHEN {RATIO} = '1:1' THEN CASE WHEN face_frac >= 0.30e0 THEN 'closeup' ELSE 'portrait' END ELSE 'portrait' END"
GATE = "face_fd <= 0.45e0 AND sharpness >= 0.10e0"


def _q(c=F.col):
    return _fixed(scores.quality(c("face_fd"), c("sharpness"), c("exposure"), c("face_quality"), c("wmark"), F.lit(0.0)))


def _classed(items: DataFrame) -> DataFrame:
    ratio = scores.ratio_class(F.col("w"), F.col("h"))
    return items.withColumn("ratio", ratio).withColumn("category", scores.category(ratio, F.col("face_frac"))).withColumn("quality", _q())


def _gated(items: DataFrame) -> DataFrame:
    return _classed(items.where((F.col("face_fd") <= 0.45) & (F.col("sharpness") >= 0.10)))


def _ranked(items: DataFrame) -> DataFrame:
    caps = F.create_map(*[F.lit(x) for c, _, most in selection.QUOTAS if c != "profile" for x in (c, most)])
    order = Window.partitionBy("category").orderBy(F.desc("quality"), "face_fd", "path")
    ranked = _gated(items).withColumn("rank", F.row_number().over(order))
    largest = max(most for c, _, most in selection.QUOTAS if c != "profile")  # a plain number, so that each task hands on no more than so many a category
    return ranked.where(F.col("rank") <= largest).where(F.col("rank") <= F.element_at(caps, F.col("category")))


RANKED = f"SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality DESC, face_fd, path) AS rank FROM (SELECT *, {RATIO} AS ratio, {CATEGORY} AS category, {Q} AS quality FROM v_item WHERE {GATE}) QUALIFY rank <= CASE category WHEN 'portrait' THEN 100 WHEN 'closeup' THEN 60 WHEN 'cowboy' THEN 35 ELSE 20 END"


@query(f"SELECT category, rank, path, quality, ratio, face_fd FROM ({RANKED})")
def curate_rank(items):
    """Gate, score and class candidates; the best of each category up to its cap."""
    return _ranked(items).select("category", "rank", "path", "quality", "ratio", "face_fd")


@query(f"SELECT path, {Q} AS quality FROM v_item")
def item_quality(items):
    return items.select("path", _q().alias("quality"))


@query(f"SELECT path, {FIXED.format("greatest(0e0, least(1.5e0, q * (1 + 0.25e0 * least(1e0, greatest(0e0, face_frac - 0.33e0) / (1 - 0.33e0)))))")} AS boosted FROM (SELECT *, {Q} AS q FROM v_item)")
def closeup_boost(items):
    return items.select("path", _fixed(scores.boosted(_q(), F.col("face_frac"))).alias("boosted"))


@query(f"SELECT path, {RATIO} AS ratio, {CATEGORY} AS category, abs(yaw) >= 50 AS is_profile FROM v_item")
def ratio_class(items):
    return _classed(items).select("path", "ratio", "category", (F.abs("yaw") >= 50).alias("is_profile"))


@query(f"SELECT category, count(*) AS n, count(DISTINCT ratio) AS ratios FROM (SELECT {RATIO} AS ratio, {CATEGORY} AS category FROM v_item WHERE {GATE}) GROUP BY category")
def category_counts(items):
    return _gated(items).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("ratio").alias("ratios"))


@query("SELECT w, round(quantile_cont(sharpness, 0.5), 6) AS p50, round(quantile_cont(sharpness, 0.95), 6) AS p95, max(sharpness) AS largest FROM v_item GROUP BY w")
def sharpness_percentiles(items):
    return items.groupBy("w").agg(F.round(F.percentile("sharpness", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("sharpness", F.lit(0.95)), 6).alias("p95"), F.max("sharpness").alias("largest"))


@query(f"SELECT row_number() OVER (ORDER BY quality DESC, face_fd, path) AS rank, path AS file, printf('%04d.jpg', row_number() OVER (ORDER BY quality DESC, face_fd, path)) AS dst_file, category, quality FROM ({RANKED}) WHERE wmark < 0.5e0")
def manifest(items):
    """Written candidates, numbered anew over what could be written; at most the sum of the caps."""
    written = _ranked(items).where("wmark < 0.5")
    n = F.row_number().over(Window.orderBy(F.desc("quality"), "face_fd", "path"))
    return written.select(n.alias("rank"), F.col("path").alias("file"), F.format_string("%04d.jpg", n).alias("dst_file"), "category", "quality")


@query(f"SELECT a.path FROM ({RANKED}) a WHERE NOT EXISTS (SELECT 1 FROM v_item b WHERE b.path = a.path AND b.wmark >= 0.3e0)")
def skip_anti(items):
    return _ranked(items).join(items.where("wmark >= 0.3").select("path"), "path", "left_anti").select("path")


@query(f"SELECT b.path, b.face_fd FROM v_item b WHERE EXISTS (SELECT 1 FROM ({RANKED}) a WHERE b.path = a.path)")
def picked_semi(items):
    return items.join(_ranked(items).select("path"), "path", "left_semi").select("path", "face_fd")


@query("SELECT path, CAST(regexp_extract(path, '(?i)\\b(?:frame|f|img|i)[_\\-]?\\s*([0-9]{3,})', 1) AS DOUBLE) AS ts FROM v_item")
def ts_from_name(items):
    return items.select("path", scores.time_from_name(F.col("path")).alias("ts"))


@query("SELECT frame, id, x1c AS x1, y1c AS y1, x2c AS x2, y2c AS y2 FROM (SELECT *, greatest(0e0, least(479e0, x1)) AS x1c, greatest(0e0, least(269e0, y1)) AS y1c, greatest(0e0, least(479e0, x2)) AS x2c, greatest(0e0, least(269e0, y2)) AS y2c FROM v_person) WHERE NOT (x2c <= x1c + 2 OR y2c <= y1c + 2)", "v_person")
def box_clamp(boxes):
    clamped = boxes.select("frame", "id", *[geometry.clamp(F.col(c), 0.0, m).alias(c) for c, m in (("x1", 479.0), ("y1", 269.0), ("x2", 479.0), ("y2", 269.0))])
    return clamped.where(~((F.col("x2") <= F.col("x1") + 2) | (F.col("y2") <= F.col("y1") + 2)))


@query("SELECT frame, id, conf FROM v_person WHERE conf >= 0.35e0 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY conf DESC, id) <= 5", "v_person")
def person_gate(boxes):
    order = Window.partitionBy("frame").orderBy(F.desc("conf"), "id")
    return boxes.where(F.col("conf") >= 0.35).withColumn("n", F.row_number().over(order)).where("n <= 5").select("frame", "id", "conf")


INTER = "(greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
IOU = f"({INTER} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {INTER}))"


@query(f"SELECT a.frame, a.id AS id_a, b.id AS id_b, round({IOU}, 6) AS iou FROM v_person a JOIN v_person b ON a.frame = b.frame AND a.id < b.id", "v_person")
def box_iou(boxes):
    a, b = (boxes.select("frame", F.col("id").alias(f"id_{k}"), F.struct("x1", "y1", "x2", "y2").alias(k)) for k in "ab")
    return a.join(b, "frame").where("id_a < id_b").select("frame", "id_a", "id_b", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, id) AS n FROM v_person),
w AS (SELECT frame, 0::BIGINT AS n, []::BIGINT[] AS kept FROM o GROUP BY frame
  UNION ALL SELECT w.frame, w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE b.frame = a.frame AND list_contains(w.kept, b.id) AND {IOU} >= 0.45e0) THEN w.kept ELSE list_append(w.kept, a.id) END
  FROM w JOIN o a ON a.frame = w.frame AND a.n = w.n + 1)
SELECT frame, unnest(kept) AS id FROM w WHERE n = (SELECT max(n) FROM o WHERE o.frame = w.frame)""",
    "v_person",
)
def nms_area(boxes):
    sized = boxes.withColumn("order", -(F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return greedy.suppress_boxes(sized, ["frame"], ["order", "id"]).select("frame", "id")


@query("SELECT frame, arg_max(id, (x2 - x1) * (y2 - y1) * 1e6 - id) AS id FROM v_person GROUP BY frame", "v_person")
def largest_person(boxes):
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.groupBy("frame").agg(F.min_by("id", F.struct(-size, F.col("id"))).alias("id"))


@query("SELECT id, a AS x1, greatest(a + 1, least(round_even(x2 + m, 0), 480e0)) AS x2 FROM (SELECT *, greatest(0e0, least(479e0, round_even(x1 + m, 0))) AS a FROM (SELECT *, CASE WHEN x1 < 0 THEN -x1 WHEN x2 > 480 THEN 480 - x2 ELSE 0e0 END AS m FROM v_person))", "v_person")
def clip_shift(boxes):
    low, high = geometry.shift_inside(F.col("x1"), F.col("x2"), 480.0)
    return boxes.select("id", low.alias("x1"), high.alias("x2"))


@query("SELECT id, CASE id % 4 WHEN 1 THEN y1 WHEN 2 THEN 479 - x1 WHEN 3 THEN 479 - y1 ELSE x1 END AS x, CASE id % 4 WHEN 1 THEN 269 - x1 WHEN 2 THEN 269 - y1 WHEN 3 THEN x1 ELSE y1 END AS y, CAST(ceil((x2 - x1) / 32) * 32 AS BIGINT) AS width_32 FROM v_person", "v_person")
def rot_point(boxes):
    x, y = geometry.rotated_back(F.col("x1"), F.col("y1"), (F.col("id") % 4) * 90, 480.0, 270.0)
    return boxes.select("id", x.alias("x"), y.alias("y"), geometry.round_up(F.col("x2") - F.col("x1"), 32).alias("width_32"))


@query("SELECT video_id, frame_idx, id FROM v_frame WHERE frame_idx % 2 = 0", "v_frame")
def stride_sample(frames):
    return frames.where(F.pmod("frame_idx", F.lit(2)) == 0).select("video_id", "frame_idx", "id")


@query("SELECT id, least(fd, rd) AS by_min, round(CASE WHEN rd IS NULL THEN 0.7e0 * fd + 0.15e0 ELSE 0.7e0 * fd + 0.3e0 * rd END, 6) AS by_face, coalesce(fd <= 0.45e0, false) OR coalesce(rd <= 0.2e0, false) AS accepted FROM v_frame", "v_frame")
def accept_rule(frames):
    fd, rd = F.col("fd"), F.col("rd")
    return frames.select("id", scores.combined(fd, rd).alias("by_min"), F.round(scores.combined(fd, rd, "face_priority"), 6).alias("by_face"), scores.accepted(fd, rd, 0.45, 0.2).alias("accepted"))


@query(
    """SELECT id, row_number() OVER (PARTITION BY video_id, hits ORDER BY frame_idx) - CASE WHEN hits > 0 THEN 1 ELSE 0 END AS streak, frame_idx - last_hit AS since_hit
FROM (SELECT *, sum(CASE WHEN fd < 9 THEN 1 ELSE 0 END) OVER w AS hits, max(CASE WHEN fd < 9 THEN frame_idx END) OVER w AS last_hit FROM v_frame WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))""",
    "v_frame",
)
def no_face_streak(frames):
    """Frames without a face since the last hit, and how far back that was."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    hit = F.col("fd") < 9
    marked = frames.withColumn("hits", F.count_if(hit).over(w)).withColumn("last_hit", F.last(F.when(hit, F.col("frame_idx")), ignorenulls=True).over(w))
    streak = F.row_number().over(Window.partitionBy("video_id", "hits").orderBy("frame_idx")) - F.when(F.col("hits") > 0, 1).otherwise(0)
    return marked.select("id", streak.alias("streak"), (F.col("frame_idx") - F.col("last_hit")).alias("since_hit"))


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.id, floor((1 - {DOT} / (greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-6) * greatest(sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-6))) * 1e6 + 0.5e0) / 1e6 AS fd FROM v_vec a JOIN v_vec b ON b.id = 0", "v_vec")
def ref_distance(vecs):
    """Distance to one reference vector, which is a single row."""
    ref = vecs.where("id = 0").select(F.col("embedding").alias("ref")).limit(1)
    return vecs.crossJoin(F.broadcast(ref)).select("id", _fixed(vectors.face_distance(F.col("embedding"), F.col("ref"))).alias("fd"))


@query(f"SELECT a.scene_hint, a.id AS id_a, b.id AS id_b, round({DOT}, 6) AS sim FROM v_vec a JOIN v_vec b ON a.scene_hint = b.scene_hint AND a.id < b.id", "v_vec")
def scene_gram(vecs):
    """All pairs of each label, block by block; the result itself grows with the square of a label's rows."""
    return pairs.pairs_of_groups(vecs, "scene_hint", "id", "embedding", pairs.dots(6), "sim", "double")


HASH = "CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(pow(2::DOUBLE, i) AS HUGEINT) ELSE 0 END)) AS BIGINT)"


@query(f"SELECT a.scene_hint, a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.p, b.p)) AS INTEGER) AS bits FROM (SELECT *, {HASH} AS p FROM v_vec) a JOIN (SELECT *, {HASH} AS p FROM v_vec) b ON a.scene_hint = b.scene_hint AND a.id < b.id WHERE bit_count(xor(a.p, b.p)) <= 20", "v_vec")
def hamming_pairs(vecs):
    hashed = vecs.select("scene_hint", "id", vectors.sign_hash("embedding").alias("hash"))
    return pairs.pairs_of_groups(hashed, "scene_hint", "id", "hash", pairs.near_bits(20), "bits", "int")


@query(
    f"""WITH RECURSIVE o AS (SELECT *, {HASH} AS p, row_number() OVER (PARTITION BY scene_hint ORDER BY q DESC, id) AS n FROM v_vec),
w AS (SELECT scene_hint, 0::BIGINT AS n, []::BIGINT[] AS ids, []::BIGINT[] AS kept FROM o GROUP BY scene_hint
  UNION ALL SELECT w.scene_hint, w.n + 1, CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, a.p)) <= 24)) > 0 THEN w.ids ELSE list_append(w.ids, a.id) END,
    CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, a.p)) <= 24)) > 0 THEN w.kept ELSE list_append(w.kept, a.p) END
  FROM w JOIN o a ON a.scene_hint = w.scene_hint AND a.n = w.n + 1)
SELECT scene_hint, unnest(ids) AS id FROM w WHERE n = (SELECT max(n) FROM o WHERE o.scene_hint = w.scene_hint)""",
    "v_vec",
)
def dedup_in_scene(vecs):
    hashed = vecs.select("scene_hint", (-F.col("q")).alias("order"), "id", vectors.sign_hash("embedding").alias("hash"))
    return greedy.drop_near_hashes(hashed, ["scene_hint"], ["order", "id"], "hash", 24).select("scene_hint", "id")


@query(on="v_vec")
def mmr_order(vecs):
    return greedy.diverse_order(vecs.select("scene_hint", "id", "q", F.col("embedding").alias("vec")), ["scene_hint"], 0.75, 10)


def _scenes(vecs):
    rows = vecs.select(F.col("scene_hint").alias("pool"), "id", "ts", F.col("id").cast("string").alias("path"), vectors.sign_hash("embedding").alias("hash"), F.col("embedding").alias("clip"), "q")
    return rows, scenes.cluster_scenes(rows, "pool", similarity=0.3, most_bits=20)


@query(on="v_vec")
def scene_cluster(vecs):
    return _scenes(vecs)[1]


@query(on="v_vec")
def scene_stats(vecs):
    sizes = _scenes(vecs)[1].groupBy("pool", "scene").agg(F.count("*").alias("size"))
    return sizes.groupBy("pool").agg(F.count("*").alias("scenes"), F.percentile("size", F.lit(0.5)).alias("p50"), F.percentile("size", F.lit(0.95)).alias("p95"), F.max("size").alias("largest"))


@query(on="v_vec")
def curate_select(vecs):
    """Scenes, order inside scenes and quota selection, pool by pool."""
    rows, found = _scenes(vecs)
    categories = F.element_at(F.array(*[F.lit(c) for c, _, _ in selection.QUOTAS if c != "profile"]), F.pmod(F.col("id"), F.lit(5)).cast("int") + 1)
    ready = rows.join(found, ["pool", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("pool", "scene").orderBy(F.desc("q"), "id")))
    ready = ready.withColumn("category", categories).withColumn("is_profile", F.col("id") % 9 == 0).withColumnRenamed("clip", "vec")
    picked = selection.select_by_quota(ready, "pool", selection.Quotas(most=30))
    return picked.withColumns({c: F.round(c, 6) for c in ("quality", "redundancy", "score")})


CURVES = "SELECT *, l_q / 50e0 AS v FROM (SELECT id, path, sharpness * 50e0 AS l_q FROM v_item)"


@query(f"SELECT path, round(pow(greatest(pow(v, 1 / 78.84375e0) - 0.8359375e0, 0e0) / greatest(18.8515625e0 - 18.6875e0 * pow(v, 1 / 78.84375e0), 1e-6), 1 / 0.1593017578125e0), 6) AS pq, round(CASE WHEN v <= 0.5e0 THEN v * v / 3 ELSE (exp((v - 0.55991073e0) / 0.17883277e0) + 0.28466892e0) / 12 END, 6) AS hlg, round((v * (0.15e0 * v + 0.05e0) + 0.004e0) / (v * (0.15e0 * v + 0.5e0) + 0.06e0) - 0.02e0 / 0.3e0, 6) AS hable FROM ({CURVES})")
def transfer_curves(items):
    v = F.col("sharpness")
    return items.select("path", F.round(color.pq_to_linear(v), 6).alias("pq"), F.round(color.hlg_to_linear(v), 6).alias("hlg"), F.round(color.hable(v), 6).alias("hable"))


def queries() -> dict:
    from . import capture, capture_flow, detail, flow  # noqa: F401  register more queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import capture, capture_flow, detail, flow  # noqa: F401

    return dict(ORACLE)
