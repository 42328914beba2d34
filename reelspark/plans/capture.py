"""Queries of the capture side: crops, landmarks, probing, hits, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import align, color, crops, geometry, images, pictures, probe, regions, scores, vectors
from ..operators import bank, greedy
from ..streaming import copies, lock
from .catalogue import IOU, _fixed, query

CLAMP = "greatest(0e0, least({}, {}))"


def _expanded_sql(bias: str = "0e0") -> str:
    grown = f"SELECT *, x1 + w * 0.5e0 AS cx, y1 + h * 0.5e0 - {bias} * h AS cy, CASE WHEN w / h < t THEN h * t ELSE w END * 0.5e0 AS ex, CASE WHEN w / h < t THEN h ELSE w / t END * 0.5e0 AS ey FROM (SELECT *, 2e0 / 3e0 AS t, greatest(1e0, x2 - x1) AS w, greatest(1e0, y2 - y1) AS h FROM v_person)"
    cut = f"SELECT id, t, {CLAMP.format('479e0', 'cx - ex')} AS a, {CLAMP.format('269e0', 'cy - ey')} AS b, {CLAMP.format('479e0', 'cx + ex')} AS c, {CLAMP.format('269e0', 'cy + ey')} AS d FROM ({grown})"
    moved = f"SELECT *, CASE WHEN (c - a) / (d - b) - t > 1e-4 THEN ((c - a) - (d - b) * t) * 0.5e0 ELSE 0e0 END AS mx, CASE WHEN (c - a) / (d - b) - t < -1e-4 THEN ((d - b) - (c - a) / t) * 0.5e0 ELSE 0e0 END AS my FROM ({cut})"
    return f"SELECT id, round_even({CLAMP.format('479e0', 'a + mx')}, 0) AS x1, round_even({CLAMP.format('269e0', 'b + my')}, 0) AS y1, round_even({CLAMP.format('479e0', 'c - mx')}, 0) AS x2, round_even({CLAMP.format('269e0', 'd - my')}, 0) AS y2 FROM ({moved})"


@query(_expanded_sql(), "v_person")
def expand_ratio(boxes):
    return crops.expand_to_ratio(boxes.select("id", "x1", "y1", "x2", "y2"), 2 / 3, 480.0, 270.0)


@query(_expanded_sql("(-(0.9e0 * (h * 0.25e0) / h))"), "v_person")
def head_bias(boxes):
    """Crops that leave room above a head of a quarter of the box's height."""
    h = F.col("_h")
    return crops.expand_to_ratio(boxes.select("id", "x1", "y1", "x2", "y2"), 2 / 3, 480.0, 270.0, head_bias=-(0.9 * (h * 0.25) / h))


def _shifted_sql(low: str, high: str, size: int) -> tuple[str, str]:
    move = f"CASE WHEN {low} < 0 THEN -({low}) WHEN {high} > {size} THEN {size}e0 - ({high}) ELSE 0e0 END"
    first = f"greatest(0e0, least({size - 1}e0, round_even({low} + {move}, 0)))"
    return first, f"greatest({first} + 1, least({size}e0, round_even({high} + {move}, 0)))"


_XS, _YS = _shifted_sql("((x1 + x2) / 2e0 - n * 0.75e0 / 2e0)", "((x1 + x2) / 2e0 + n * 0.75e0 / 2e0)", 480), _shifted_sql("((y1 + y2) / 2e0 - n / 2e0)", "((y1 + y2) / 2e0 + n / 2e0)", 270)


@query(
    f"""SELECT id, CASE WHEN n IS NULL THEN x1 ELSE {_XS[0]} END AS x1, CASE WHEN n IS NULL THEN y1 ELSE {_YS[0]} END AS y1, CASE WHEN n IS NULL THEN x2 ELSE {_XS[1]} END AS x2, CASE WHEN n IS NULL THEN y2 ELSE {_YS[1]} END AS y2
FROM (SELECT *, CASE WHEN h + 0.5e0 < need THEN need WHEN h > greatest(fh / 0.18e0, need) + 0.5e0 THEN greatest(fh / 0.18e0, need) END AS n
FROM (SELECT *, greatest(h, 75.6e0, fh / 0.42e0, (fw + 0.6e0 * fw) / 0.75e0) AS need FROM (SELECT *, y2 - y1 AS h, (id % 9) * 20e0 AS fw, (id % 7) * 15e0 + 10e0 AS fh FROM v_person)))""",
    "v_person",
)
def enforce_scale(boxes):
    return crops.enforce_scale(boxes.select("id", "x1", "y1", "x2", "y2"), 0.75, 480.0, 270.0, ((F.col("id") % 9) * 20.0, (F.col("id") % 7) * 15.0 + 10.0))


@query("SELECT id, floor(least(x1, x2) - 5) AS x1, floor((y1 - 3) / 2) AS y1, ceil(x2 - 5) AS x2, ceil((y2 - 3) / 2) AS y2 FROM v_person", "v_person")
def affine_box(boxes):
    back = crops.affine_box((1.0, 0.0, 5.0, 0.0, 2.0, 3.0), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return boxes.select("id", *[b.alias(c) for b, c in zip(back, ("x1", "y1", "x2", "y2"))])


@query("SELECT path, floor(s * 1e6 + 0.5e0) / 1e6 AS scale, CAST(floor((640 - round_even(w * s, 0)) / 2) AS BIGINT) AS dx, CAST(floor((640 - round_even(h * s, 0)) / 2) AS BIGINT) AS dy FROM (SELECT *, least(640 / w, 640 / h) AS s FROM v_item)")
def letterbox(items):
    box = crops.letterbox(F.col("w"), F.col("h"))
    return items.select("path", _fixed(box["scale"]).alias("scale"), box["dx"].alias("dx"), box["dy"].alias("dy"))


@query("SELECT path, e AS width, greatest(2, CAST(floor(e * (h / w)) AS BIGINT) & -2) AS height FROM (SELECT *, CAST(trunc(w * 0.37e0) AS BIGINT) & -2 AS e FROM v_item)")
def even_cap(items):
    width, height = crops.even_size((F.col("w") * 0.37).cast("long"), F.col("h") / F.col("w"))
    return items.select("path", width.alias("width"), height.alias("height"))


def _face(boxes):
    """Five made-up points in each box, in no order; some cannot be a face."""
    spots = [(0.7, 0.7), (0.3, 0.3), (0.5, 0.5), (0.3, 0.72), (0.68, 0.31)]
    x, y = (lambda a: F.col("x1") + (F.col("x2") - F.col("x1")) * a), (lambda b: F.col("y1") + (F.col("y2") - F.col("y1")) * b)
    nose = F.when(F.col("id") % 5 == 0, 0.31).otherwise(0.5)
    return F.array(*[F.struct(x(a).alias("x"), y(nose if b == 0.5 else F.lit(b)).alias("y")) for a, b in spots])


@query("SELECT id, x1 + (x2 - x1) * 0.3e0 AS left_eye, x1 + (x2 - x1) * 0.7e0 AS right_mouth FROM v_person WHERE id % 5 <> 0", "v_person")
def canon_landmarks(boxes):
    placed = crops.ordered_landmarks(_face(boxes))
    return boxes.withColumn("p", placed).where("p IS NOT NULL").selectExpr("id", "p[0].x AS left_eye", "p[4].x AS right_mouth")


_W, _T = "((x2 - x1) * 0.38e0)", "((y2 - y1) * 0.01e0)"


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 0e0 ELSE round(degrees(atan2((x2 - x1) * 0.01e0, sqrt({_W} * {_W} + {_T} * {_T}) + 1e-6)), 4) END AS yaw, CASE WHEN id % 5 = 0 THEN 0e0 ELSE round(degrees(atan2({_T}, {_W})), 4) END AS roll FROM v_person", "v_person")
def yaw_roll(boxes):
    angles = vectors.bound(crops.ordered_landmarks(_face(boxes)), lambda p: F.struct(*[F.round(a, 4).alias(k) for k, a in zip(("yaw", "roll"), crops.yaw_roll(p))]))
    return boxes.select("id", angles.alias("a")).select("id", "a.yaw", "a.roll")


@query("SELECT id, CASE WHEN abs(f) < 8 THEN 0e0 WHEN f > 80 THEN 90e0 WHEN f < -80 THEN -90e0 ELSE f END AS turn FROM (SELECT id, CASE WHEN a < -90 THEN a + 180 WHEN a > 90 THEN a - 180 ELSE a END AS f FROM (SELECT id, CAST(id * 7 % 361 - 180 AS DOUBLE) AS a FROM v_person))", "v_person")
def eye_roll(boxes):
    return boxes.select("id", crops.levelling((F.col("id") * 7 % 361 - 180).cast("double")).alias("turn"))


@query("SELECT id, CASE WHEN (x1 + x2) / 2e0 BETWEEN 200 AND 420 AND (y1 + y2) / 2e0 BETWEEN 100 AND 140 THEN (x1 + x2) / 2e0 END AS anchor_x FROM v_person", "v_person")
def anchor_in_box(boxes):
    x, y = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    return boxes.select("id", F.when(x.between(200, 420) & y.between(100, 140), x).alias("anchor_x"))


@query("SELECT a.frame, a.id, b.id AS body FROM v_person a JOIN v_person b ON a.frame = b.frame AND a.id <> b.id AND (a.x1 + a.x2) / 2e0 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2e0 BETWEEN b.y1 AND b.y2", "v_person")
def face_in_person(boxes):
    """Pairs in which one box's centre lies in the other; the frame is the key, so no pair leaves its frame."""
    faces = boxes.selectExpr("frame", "id", "(x1 + x2) / 2.0D AS cx", "(y1 + y2) / 2.0D AS cy")
    bodies = boxes.withColumnRenamed("id", "body")
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    return faces.join(bodies, "frame").where(inside & (F.col("id") != F.col("body"))).select("frame", "id", "body")


@query(f"SELECT id, arg AS partner FROM (SELECT a.id, b.id AS arg, row_number() OVER (PARTITION BY a.id ORDER BY {IOU} DESC, b.id) AS n FROM v_person a JOIN v_person b ON a.frame = b.frame AND a.id <> b.id) WHERE n = 1", "v_person")
def iou_match(boxes):
    """Each box's partner in its frame. Pairs are only counted by plain numbers, so that none is sorted or held: first the best overlap, then the least id of it."""
    a, b = (boxes.select("frame", F.col("id").alias(f"id_{k}"), F.struct("x1", "y1", "x2", "y2").alias(k)) for k in "ab")
    overlap = geometry.iou(F.col("a"), F.col("b"))
    best = a.join(b, "frame").where("id_a <> id_b").groupBy("frame", "id_a").agg(F.max(overlap).alias("most"))  # both by frame: one exchange
    those = a.join(best.select(F.col("frame").alias("f"), F.col("id_a").alias("i"), "most"), (F.col("frame") == F.col("f")) & (F.col("id_a") == F.col("i"))).select("frame", "id_a", "a", "most")
    least = those.join(b, "frame").where((F.col("id_a") != F.col("id_b")) & (overlap == F.col("most"))).groupBy("frame", "id_a").agg(F.min("id_b").alias("partner"))
    return least.select(F.col("id_a").alias("id"), "partner")


@query("SELECT frame, id, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, (x2 - x1) * (y2 - y1) DESC, id) AS place FROM v_person WHERE conf >= 0.05e0 AND x2 - x1 >= 8 AND y2 - y1 >= 8 AND (x2 - x1) * (y2 - y1) >= 1024", "v_person")
def faces_order(boxes):
    """Faces large and sure enough, best first; place 1 is the best face."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    kept = boxes.where((F.col("conf") >= 0.05) & (w >= 8) & (h >= 8) & (w * h >= 1024))
    return kept.select("frame", "id", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("conf"), -(w * h), "id")).alias("place"))


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, (x2 - x1) * (y2 - y1) DESC, id) AS n FROM v_person),
w AS (SELECT frame, 0::BIGINT AS n, []::BIGINT[] AS kept FROM o GROUP BY frame
  UNION ALL SELECT w.frame, w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE b.frame = a.frame AND list_contains(w.kept, b.id) AND {IOU} >= 0.45e0) THEN w.kept ELSE list_append(w.kept, a.id) END
  FROM w JOIN o a ON a.frame = w.frame AND a.n = w.n + 1)
SELECT frame, unnest(kept) AS id FROM w WHERE n = (SELECT max(n) FROM o WHERE o.frame = w.frame)""",
    "v_person",
)
def nms_scored(boxes):
    sized = boxes.withColumn("order", -F.col("conf")).withColumn("order2", -(F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return greedy.suppress_boxes(sized, ["frame"], ["order", "order2", "id"]).select("frame", "id")


@query("SELECT frame_idx AS frame, printf('%.3f', frame_idx / 25e0) AS time_secs, printf('f%08d.jpg', frame_idx) AS crop_path, id FROM v_frame WHERE coalesce(fd <= 0.45e0, false) OR coalesce(rd <= 0.2e0, false)", "v_frame")
def hit_index(frames):
    """Rows of the hit index: accepted frames with their time and the name of the crop."""
    n = F.col("frame_idx")
    hits = frames.where(scores.accepted(F.col("fd"), F.col("rd"), 0.45, 0.2))
    return hits.select(n.alias("frame"), F.format_string("%.3f", n / 25.0).alias("time_secs"), F.format_string("f%08d.jpg", n).alias("crop_path"), "id")


@query("SELECT id, CAST(round_even(frame_idx * 1001 * 0.001e0 * 25, 0) AS BIGINT) AS idx, CASE id % 4 WHEN 0 THEN 30000e0 / 1001e0 WHEN 1 THEN 25e0 WHEN 2 THEN 30e0 ELSE 24e0 END AS fps FROM v_frame", "v_frame")
def pts_index(frames):
    text = F.element_at(F.array(*[F.lit(t) for t in ("30000/1001", "25/0", "x/y", "24")]), (F.col("id") % 4 + 1).cast("int"))
    return frames.select("id", F.rint(F.col("frame_idx") * 1001 * 0.001 * 25).cast("long").alias("idx"), crops.frame_rate(text).alias("fps"))


@query(
    """WITH s AS (SELECT *, CASE WHEN fd <= 0.45e0 THEN 1 WHEN fd > 0.6e0 THEN 0 END AS sign FROM v_frame),
t AS (SELECT *, coalesce(last_value(sign IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx), 0) AS inside FROM s),
u AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM t WHERE inside = 1),
v AS (SELECT video_id, greatest(0, min(frame_idx) - 1) AS a, max(frame_idx) + 1 AS b FROM u GROUP BY video_id, island),
x AS (SELECT *, CASE WHEN a <= 2 + max(b) OVER (PARTITION BY video_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM v),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY a) AS span FROM x)
SELECT video_id, min(a) AS span_start, max(b) AS span_end FROM y GROUP BY video_id, span HAVING max(b) - min(a) >= 3""",
    "v_frame",
)
def prescan_spans(frames):
    """Proposed: spans in which the wanted face is near, entered at 0.45 and left beyond 0.6, padded, bridged, of a least length."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    sign = F.when(F.col("fd") <= 0.45, 1).when(F.col("fd") > 0.6, 0)
    inside = frames.withColumn("inside", F.last(sign, ignorenulls=True).over(w)).where("inside = 1")
    islands = inside.withColumn("island", F.col("frame_idx") - F.row_number().over(w))
    padded = islands.groupBy("video_id", "island").agg(F.greatest(F.lit(0), F.min("frame_idx") - 1).alias("a"), (F.max("frame_idx") + 1).alias("b"))
    by_start = Window.partitionBy("video_id").orderBy("a")
    reach = F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = padded.withColumn("fresh", F.when(F.col("a") <= reach + 2, 0).otherwise(1)).withColumn("span", F.sum("fresh").over(by_start))
    return spans.groupBy("video_id", "span").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).where("span_end - span_start >= 3").drop("span")


@query("SELECT a.id, floor(sqrt(list_dot_product(m, m)) * 1e6 + 0.5e0) / 1e6 AS norm, floor(m[3] * 1e6 + 0.5e0) / 1e6 AS third FROM (SELECT id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-10)) AS m FROM v_vec) a", "v_vec")
def l2_norm(vecs):
    unit = vecs.select("id", vectors.unit(F.col("embedding")).alias("m"))
    return unit.select("id", _fixed(vectors.norm(F.col("m"))).alias("norm"), _fixed(F.col("m")[2]).alias("third"))


#: Made-up probe documents, one for each frame.
PROBE = """concat('{{"streams":[{{"index":', id % 3, ',"codec_tag_string":"', CASE WHEN id % 11 = 0 THEN 'dvh1' ELSE 'hvc1' END, '","color_transfer":"', CASE id % 5 WHEN 0 THEN 'SMPTE2084' WHEN 1 THEN 'hlg' ELSE 'bt709' END,
'","color_primaries":"', CASE WHEN id % 2 = 0 THEN 'bt2020' ELSE 'bt709' END, '","color_range":"', CASE WHEN id % 3 = 0 THEN 'pc' ELSE 'tv' END, '","pix_fmt":"', CASE WHEN id % 7 < 3 THEN 'yuv420p10le' ELSE 'yuv420p' END,
'","side_data_list":[{{"side_data_type":"', CASE WHEN id % 13 = 0 THEN 'Content light level metadata' ELSE 'Display Matrix' END, '"}}]}}]}}')"""
_RULES = "CASE WHEN id % 11 = 0 THEN concat('v:', id % 3, ' dolby-vision tag=dvh1') WHEN id % 5 = 0 THEN concat('v:', id % 3, ' transfer=smpte2084') WHEN id % 5 = 1 THEN concat('v:', id % 3, ' transfer=hlg') WHEN id % 13 = 0 THEN concat('v:', id % 3, ' hdr side-data (content light level metadata)') WHEN id % 7 < 3 AND id % 2 = 0 THEN concat('v:', id % 3, ' bt2020 yuv420p10le') ELSE 'no HDR signal across video streams' END"


@query(f"SELECT id, {_RULES} AS reason, CASE WHEN id % 3 = 0 THEN 'full' ELSE 'limited' END AS color_range, CASE WHEN {_RULES} LIKE 'v:%' THEN 'filter' ELSE 'plain' END AS reader FROM v_frame", "v_frame")
def hdr_detect(frames):
    streams = F.from_json(F.expr(PROBE.format()), probe.STREAMS)["streams"]
    found = frames.select("id", streams.alias("s")).select("id", probe.first_hdr_reason(F.col("s")).alias("reason"), probe.colour_range(F.col("s")).alias("color_range"))
    return found.withColumn("reader", probe.reader(F.col("reason").startswith("v:")))


_GRAY = "flatten([[greatest(0e0, least(255e0, floor(128 + 3000e0 * embedding[i]::DOUBLE * embedding[j]::DOUBLE))) for j in range(33, 65)] for i in range(1, 33)])"


def _gray(vecs):
    """A picture of 32 x 32 from each vector of 64."""
    e = F.col("embedding")
    level = lambda x, y: geometry.clamp(F.floor(128 + 3000.0 * x.cast("double") * y.cast("double")).cast("double"), 0.0, 255.0)
    return F.flatten(F.transform(F.slice(e, 1, 32), lambda x: F.transform(F.slice(e, 33, 32), lambda y: level(x, y))))


@query(f"SELECT id, round(greatest(0e0, least(1e0, len(list_filter(g, lambda p: p >= 16 AND p < 240)) / 1024e0 - 0.5e0 * (len(list_filter(g, lambda p: p < 8)) / 1024e0 + len(list_filter(g, lambda p: p >= 248)) / 1024e0))), 6) AS exposure FROM (SELECT id, {_GRAY} AS g FROM v_vec)", "v_vec")
def exposure_hist(vecs):
    return vecs.select("id", F.round(images.exposure(_gray(vecs)), 6).alias("exposure"))


def _pictures(vecs):
    code = F.transform(_gray(vecs), lambda p: F.lpad(F.hex(p.cast("int")), 2, "0"))
    return vecs.select("id", F.unhex(F.concat_ws("", code)).alias("pixels"), F.lit(32).alias("w"), F.lit(32).alias("h"))


@query(on="v_vec")
def picture_measures(vecs):
    """Sharpness, perceptual hash and content box; held against loops in the tests."""
    return images.measure(_pictures(vecs), ["id"]).withColumn("sharpness", F.round("sharpness", 6))


@query(f"SELECT id, 32 AS w, 32 AS h, 3 AS channels, 8 AS bits, md5(list_aggregate(list_transform(g, lambda p: repeat(printf('%02X', CAST(p AS INTEGER)), 3)), 'string_agg', '')) AS digest FROM (SELECT id, {_GRAY} AS g FROM v_vec)", "v_vec")
def picture_files(vecs):
    """Pictures written as PNG of three channels and read back: what the files say of themselves, and a digest of all pixels."""
    three = F.regexp_replace(F.hex("pixels"), "(..)", "$1$1$1")
    files = pictures.encoded(_pictures(vecs).withColumn("pixels", F.unhex(three)), ["id"])
    return pictures.decoded(files, ["id"]).select("id", "w", "h", "channels", "bits", F.md5(F.hex("pixels").cast("binary")).alias("digest"))


@query(on="v_vec")
def picture_regions(vecs):
    """Pictures, how many stable regions they have and how much of their corners looks like text; the tests hold some against flood fills."""
    made = _pictures(vecs)
    found = regions.stable_regions(made.withColumn("own", F.col("pixels")), ["id", "own"], least=4)
    return found.select("id", F.col("own").alias("pixels"), F.size("regions").alias("regions"), regions.corner_score(F.col("regions"), F.col("w"), F.col("h")).alias("score"))


@query(on="v_vec")
def face_chips(vecs):
    """Chips of pictures whose five points lie near the template; the first or the second of them is misplaced."""
    points = [F.lit(v * 32 / 112) + F.pmod(F.col("id") * (k + 3), F.lit(7)) / 10 + F.when(F.col("id") % 3 == k, 9.0).otherwise(0.0) for k, v in enumerate(v for point in align.TEMPLATE for v in point)]
    return align.aligned(_pictures(vecs).withColumn("points", F.array(*points)), ["id"], channels=1)


@query(on="v_frame")
def lock_frames(frames):
    """The lock on a face along videos of two faces a frame, boxes made up from ids. The tests hold the operator: its saves against loops, its steps by small cases."""
    x, y = F.pmod("id", F.lit(3)) * 200.0, F.pmod("id", F.lit(9)) * 1.0
    frame = F.floor(F.col("frame_idx") / 2)
    faces = frames.select("video_id", F.timestamp_micros(frame * 40_000).alias("ts"), frame.alias("frame_idx"), "id", "fd", x.alias("x1"), y.alias("y1"), (x + 50).alias("x2"), (y + 60).alias("y2"))
    return lock.locked_frames(faces)


@query(on="v_vec")
def bank_changes(vecs):
    """What enters the bank of each label, and in whose place, along ids half a second apart; distances made up from ids. The tests hold it against loops."""
    i = F.col("id")
    given = vecs.select("scene_hint", F.timestamp_micros(i * 500_000).alias("ts"), "id", ((i * 53 % 100) / 180.0).alias("fd"), F.when(i % 11 != 0, F.col("q")).alias("q"), F.when(i % 7 != 0, F.col("embedding")).alias("vec"))
    return bank.managed(given, "scene_hint", bank.BankSpec(apart=0.4, pause=1, most=8))


@query(on="v_vec")
def copies_in_time(vecs):
    """Each vector and the earlier one of its label, kept less than a minute before, that its hash is a near copy of; the tests hold it against loops."""
    given = vecs.select("scene_hint", F.timestamp_micros(F.col("id") * 500_000).alias("ts"), "id", F.when(F.col("id") % 13 != 0, vectors.sign_hash("embedding")).alias("hash"))
    return copies.near_copies(given, "scene_hint", 20, 60.0)


_C, _D, _E = "(id % 256 - 16)", "(id * 7 % 256 - 128)", "(id * 13 % 256 - 128)"
_RGB = [f"1.16438356e0 * {_C} + 1.79274107e0 * {_E}", f"1.16438356e0 * {_C} - 0.21324861e0 * {_D} - 0.53290933e0 * {_E}", f"1.16438356e0 * {_C} + 2.11240179e0 * {_D}"]


@query("SELECT id, " + ", ".join(f"CAST(floor({CLAMP.format('255e0', x)}) AS BIGINT) AS {c}" for c, x in zip("rgb", _RGB)) + " FROM v_frame", "v_frame")
def nv12_bgr(frames):
    i = F.col("id")
    made = color.limited_to_rgb(i % 256, i * 7 % 256, i * 13 % 256)
    return frames.select("id", *[x.alias(c) for c, x in zip("rgb", made)])


_Y, _U, _V = (f"((id * {k} % 1024 - {less}) / {by}e0)" for k, less, by in ((1, 64, 876), (5, 512, 896), (11, 512, 896)))
_L = CLAMP.format("1e0", _Y)


@query(f"SELECT id, floor({CLAMP.format('1e0', f'{_L} + 1.4746e0 * {_V}')} * 1e6 + 0.5e0) / 1e6 AS r, floor({CLAMP.format('1e0', f'{_L} - 0.164553e0 * {_U} - 0.571353e0 * {_V}')} * 1e6 + 0.5e0) / 1e6 AS g, floor({CLAMP.format('1e0', f'{_L} + 1.8814e0 * {_U}')} * 1e6 + 0.5e0) / 1e6 AS b FROM v_frame", "v_frame")
def p010_rgb(frames):
    word = lambda k: F.shiftleft(F.col("id") * k % 1024, 6)
    return frames.select("id", *[_fixed(x).alias(c) for c, x in zip("rgb", color.p010_to_rgb(word(1), word(5), word(11)))])


@query("SELECT id, fd <= 0.45e0 OR coalesce(rd <= 0.2e0, false) AS either, coalesce(fd <= 0.45e0 AND rd <= 0.2e0, false) AS \"both\", fd <= 0.45e0 AS face_only, coalesce(rd <= 0.2e0, false) AS reid_only FROM v_frame", "v_frame")
def match_mode(frames):
    """Proposed: the four ways to accept a frame."""
    modes = ("either", "both", "face_only", "reid_only")
    return frames.select("id", *[scores.matched(F.col("fd"), F.col("rd"), m, 0.45, 0.2).alias(m) for m in modes])


@query("SELECT id FROM (SELECT *, bool_or(fd < 9) OVER (PARTITION BY video_id, frame_idx // 4) AS seen FROM v_frame) WHERE fd <= 0.45e0 OR (coalesce(rd <= 0.2e0, false) AND NOT seen)", "v_frame")
def visible_face_gate(frames):
    """Proposed: hits by body alone count only where no face is visible among neighbours."""
    seen = F.bool_or(F.col("fd") < 9).over(Window.partitionBy("video_id", F.floor(F.col("frame_idx") / 4)))
    marked = frames.withColumn("seen", seen)
    return marked.where((F.col("fd") <= 0.45) | (F.coalesce(F.col("rd") <= 0.2, F.lit(False)) & ~F.col("seen"))).select("id")


@query(
    """SELECT id, streak <= 2 OR (streak - 2) % 3 = 0 AS probed FROM (SELECT *, row_number() OVER (PARTITION BY video_id, hits ORDER BY frame_idx) - CASE WHEN hits > 0 THEN 1 ELSE 0 END AS streak
FROM (SELECT *, sum(CASE WHEN fd < 9 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS hits FROM v_frame))""",
    "v_frame",
)
def fd9_skip(frames):
    """Proposed: after two frames without a face only every third is looked at until a face is back."""
    hits = frames.withColumn("hits", F.count_if(F.col("fd") < 9).over(Window.partitionBy("video_id").orderBy("frame_idx")))
    streak = F.row_number().over(Window.partitionBy("video_id", "hits").orderBy("frame_idx")) - F.when(F.col("hits") > 0, 1).otherwise(0)
    return hits.withColumn("streak", streak).select("id", ((F.col("streak") <= 2) | ((F.col("streak") - 2) % 3 == 0)).alias("probed"))


@query(
    """WITH RECURSIVE o AS (SELECT video_id, frame_idx, id FROM v_frame WHERE fd <= 0.45e0),
w AS (SELECT video_id, min(frame_idx) AS frame_idx FROM o GROUP BY video_id
  UNION ALL SELECT w.video_id, (SELECT min(o.frame_idx) FROM o WHERE o.video_id = w.video_id AND o.frame_idx >= w.frame_idx + 5) FROM w WHERE EXISTS (SELECT 1 FROM o WHERE o.video_id = w.video_id AND o.frame_idx >= w.frame_idx + 5))
SELECT o.id FROM w JOIN o USING (video_id, frame_idx)""",
    "v_frame",
)
def min_gap(frames):
    """Proposed: saves at least five frames apart, chosen in order."""
    hits = frames.where(F.col("fd") <= 0.45).select("video_id", "frame_idx", "id")
    return greedy.spaced(hits, ["video_id"], "frame_idx", "id", 5)


@query("SELECT id, floor(n * 1e6 + 0.5e0) / 1e6 AS norm, floor(m[64] / (n + 1e-6) * 1e6 + 0.5e0) / 1e6 AS last FROM (SELECT id, m, sqrt(list_dot_product(m, m)) AS n FROM (SELECT id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-6) * 0.6e0) AS m FROM v_vec))", "v_vec")
def mix_vector(vecs):
    """A face vector of weight 0.6 without a background: the norm before it is made 1, and the last coordinate."""
    e = F.col("embedding")
    one = vectors.mixed(e, F.lit(None).cast("array<float>"), 0.6, 1.0)
    made = vecs.select("id", (vectors.norm(e) / (vectors.norm(e) + 1e-6) * 0.6).alias("norm"), one.alias("m"))
    return made.select("id", _fixed(F.col("norm")).alias("norm"), _fixed(F.col("m")[63]).alias("last"))


@query("SELECT 'category' AS kind, category AS name, n FROM (SELECT CASE id % 3 WHEN 0 THEN 'closeup' WHEN 1 THEN 'portrait' ELSE 'wide' END AS category, count(*) AS n FROM v_item GROUP BY 1) UNION ALL SELECT 'profile', 'profile', count(*) FROM v_item WHERE abs(yaw) >= 50 UNION ALL SELECT 'scene', 'distinct', count(DISTINCT w) FROM v_item")
def run_summary(items):
    """Counts by category, of profiles and of distinct scenes; no row gathers a set of values."""
    category = F.element_at(F.array(F.lit("closeup"), F.lit("portrait"), F.lit("wide")), (F.col("id") % 3 + 1).cast("int"))
    counted = items.groupBy(category.alias("c")).agg(F.count("*").alias("n"), F.count_if(F.abs("yaw") >= 50).alias("p"))
    rows = counted.select(F.lit("category").alias("kind"), F.col("c").alias("name"), "n")
    profiles = counted.agg(F.sum("p").alias("n")).select(F.lit("profile").alias("kind"), F.lit("profile").alias("name"), "n")
    return rows.unionByName(profiles).unionByName(items.agg(F.countDistinct("w").alias("n")).select(F.lit("scene").alias("kind"), F.lit("distinct").alias("name"), "n"))
