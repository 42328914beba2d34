"""Queries on single steps of capture, probing and writing: distances, boxes, sizes, logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color, crops, geometry, images, probe, scores, vectors
from ..operators import greedy
from .capture import _GRAY, _gray
from .catalogue import CATEGORY, DOT, FIXED, HASH, IOU, RANKED, RATIO, Q, _classed, _fixed, _ranked, query

_A, _B = (f"sqrt(list_dot_product({t}.embedding::DOUBLE[], {t}.embedding::DOUBLE[]))" for t in "ab")


@query(
    f"SELECT a.id, {FIXED.format(f'1 - {DOT} / (({_A} + 1e-9) * ({_B} + 1e-9))')} AS distance, {FIXED.format(f'{DOT} / (({_A} + 1e-6) * ({_B} + 1e-6))')} AS cosine, {FIXED.format('1 - bit_count(xor(a.p, b.p)) / 64e0')} AS alike FROM (SELECT *, {HASH} AS p FROM v_vec) a JOIN (SELECT *, {HASH} AS p FROM v_vec) b ON b.id = 7",
    "v_vec",
)
def clip_distance(vecs):
    """Cosine distance, cosine and hash similarity to one reference, which is a single row."""
    e, r = F.col("embedding"), F.col("ref")
    ref = vecs.where("id = 7").select(F.col("embedding").alias("ref"), vectors.sign_hash("embedding").alias("ref_hash")).limit(1)
    met = vecs.withColumn("hash", vectors.sign_hash("embedding")).crossJoin(F.broadcast(ref))
    return met.select("id", _fixed(vectors.cosine_distance(e, r)).alias("distance"), _fixed(vectors.cosine(e, r)).alias("cosine"), _fixed(vectors.hash_similarity(F.col("hash"), F.col("ref_hash"))).alias("alike"))


_W4, _H4 = [("least(480e0, {}) - least(480e0, x1)", "least(270e0, {}) - least(270e0, y1)")[i] for i in (0, 1)]
_HELD = "greatest(0e0, {}) * greatest(0e0, {})"
_CORNER, _SIZE = _HELD.format(_W4.format("x2"), _H4.format("y2")), _HELD.format(_W4.format("x1 + x2"), _H4.format("y1 + y2"))


@query(
    f"SELECT id, CASE WHEN id % 11 = 0 THEN 0e0 ELSE greatest(1e0, y2 - y1) / 270e0 END AS face_share, CASE WHEN id % 11 = 0 THEN 0e0 ELSE {FIXED.format(f'greatest(0e0, least(1e0, 1 - greatest(CASE WHEN x2 > x1 AND y2 > y1 THEN {_CORNER} ELSE 0e0 END, CASE WHEN x2 > 0 AND y2 > 0 THEN {_SIZE} ELSE 0e0 END) / 129600e0))')} END AS border FROM (SELECT id, x1, y1, CASE WHEN id % 3 = 0 THEN x2 ELSE x1 - 5 END AS x2, y2 FROM v_person)",
    "v_person",
)
def box_shares(boxes):
    """A face's share of its crop and the share of a picture outside its content box; both 0 where no box is."""
    some = lambda c: F.when(F.col("id") % 11 != 0, c)
    x1, y1, x2, y2 = (some(c) for c in (F.col("x1"), F.col("y1"), F.when(F.col("id") % 3 == 0, F.col("x2")).otherwise(F.col("x1") - 5), F.col("y2")))
    return boxes.select("id", geometry.face_share(y1, y2, F.lit(270.0)).alias("face_share"), _fixed(geometry.border_share((x1, y1, x2, y2), 480.0, 270.0)).alias("border"))


_FDN = "CASE WHEN fd < 9 THEN fd END"


@query(
    f"SELECT id, CASE WHEN f IS NULL THEN rd WHEN rd IS NULL THEN f ELSE least(f, rd) END AS by_min, CASE WHEN f IS NULL THEN rd WHEN rd IS NULL THEN f ELSE {FIXED.format('(f + rd) / 2')} END AS by_avg, CASE WHEN f IS NULL THEN rd ELSE {FIXED.format('0.7e0 * f + 0.3e0 * coalesce(rd, 0.5e0)')} END AS by_face FROM (SELECT *, {_FDN} AS f FROM v_frame)",
    "v_frame",
)
def combine_modes(frames):
    """One distance from two, by each mode, with either or both missing."""
    f, r = F.when(F.col("fd") < 9, F.col("fd")), F.col("rd")
    one = lambda mode: F.when(f.isNull() | (r.isNull() & (mode != "face_priority")), scores.combined(f, r, mode)).otherwise(_fixed(scores.combined(f, r, mode)))
    return frames.select("id", scores.combined(f, r).alias("by_min"), one("avg").alias("by_avg"), one("face_priority").alias("by_face"))


_BX, _BY = ("CASE id % 4 WHEN 1 THEN y{0} WHEN 2 THEN 479 - x{0} WHEN 3 THEN 479 - y{0} ELSE x{0} END", "CASE id % 4 WHEN 1 THEN 269 - x{0} WHEN 2 THEN 269 - y{0} WHEN 3 THEN x{0} ELSE y{0} END")


@query("SELECT id, " + ", ".join(f"{f}({s.format(1)}, {s.format(2)}) AS {n}" for f, s, n in (("least", _BX, "x1"), ("least", _BY, "y1"), ("greatest", _BX, "x2"), ("greatest", _BY, "y2"))) + " FROM v_person", "v_person")
def rotated_box(boxes):
    back = geometry.rotated_box_back(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), (F.col("id") % 4) * 90, 480.0, 270.0)
    return boxes.select("id", *[b.alias(c) for b, c in zip(back, ("x1", "y1", "x2", "y2"))])


_UN = "round_even(({} - {}) * (1e0 / greatest(s, 1e-6)), 0)"


@query(
    f"""SELECT id, a AS x1, b AS y1, greatest(a + 1, least(w, {_UN.format('x2', 'dx')})) AS x2, greatest(b + 1, least(h, {_UN.format('y2', 'dy')})) AS y2
FROM (SELECT *, greatest(0e0, least(w, {_UN.format('x1', 'dx')})) AS a, greatest(0e0, least(h, {_UN.format('y1', 'dy')})) AS b
FROM (SELECT *, floor((640 - round_even(w * s, 0)) / 2) AS dx, floor((640 - round_even(h * s, 0)) / 2) AS dy FROM (SELECT *, least(640 / w, 640 / h) AS s FROM (SELECT *, 600e0 + (id % 5) * 100 AS w, 400e0 + (id % 7) * 90 AS h FROM v_person))))""",
    "v_person",
)
def letterbox_inverse(boxes):
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    back = crops.unletterbox(box, 600.0 + (F.col("id") % 5) * 100, 400.0 + (F.col("id") % 7) * 90)
    return boxes.select("id", *[b.alias(c) for b, c in zip(back, ("x1", "y1", "x2", "y2"))])


_D32 = "CAST(ceil({} / 32e0) * 32 AS BIGINT)"


@query(
    f"SELECT id, plain, least({_D32.format('greatest(plain, floor(long * 0.75e0))')}, greatest(2048, plain)) AS quarter, least({_D32.format('greatest(plain, floor(long * 0.67e0))')}, greatest(2048, plain)) AS half FROM (SELECT id, {_D32.format('greatest(320, id * 37 % 2500)')} AS plain, id * 53 % 4000 AS long FROM v_person)",
    "v_person",
)
def detector_sizes(boxes):
    sizes = crops.detector_sizes(F.col("id") * 37 % 2500, F.col("id") * 53 % 4000)
    return boxes.select("id", *[c.alias(k) for k, c in sizes.items()])


_HAB = "(({0} * (0.15e0 * {0} + 0.05e0) + 0.004e0) / ({0} * (0.15e0 * {0} + 0.5e0) + 0.06e0) - 0.02e0 / 0.3e0)"
_SHOWN = "CAST(floor(greatest(0e0, least(1e0, CASE WHEN {0} < 0.018e0 THEN 4.5e0 * {0} ELSE 1.099e0 * pow({0}, 0.45e0) - 0.099e0 END)) * 255 + 0.5e0) AS BIGINT)"


@query(
    "SELECT id, " + ", ".join(f"{_SHOWN.format(f'least(1e0, least(200e0, {c} * s) / 100e0)')} AS {n}" for c, n in (("b", "blue"), ("g", "green"), ("r", "red")))
    + f""" FROM (SELECT *, greatest(0e0, least(1e0, {_HAB.format('(y / 1000e0)')} / {_HAB.format('11.2e0')})) * 200e0 / greatest(y, 1e-6) AS s
FROM (SELECT *, 0.2627e0 * r + 0.678e0 * g + 0.0593e0 * b AS y FROM (SELECT id, (id % 101) / 2000e0 * 10000e0 AS r, (id * 7 % 89) / 1000e0 * 10000e0 AS g, (id * 13 % 97) / 900e0 * 10000e0 AS b FROM v_frame)))""",
    "v_frame",
)
def tone_map(frames):
    i = F.col("id")
    shown = color.tone_mapped((i % 101) / 2000.0, (i * 7 % 89) / 1000.0, (i * 13 % 97) / 900.0)
    return frames.select("id", *[c.alias(n) for c, n in zip(shown, ("blue", "green", "red"))])


@query("SELECT id, CASE id % 4 WHEN 0 THEN 2e0 WHEN 1 THEN 16e0 WHEN 2 THEN 1.5e0 END AS w, CASE id % 4 WHEN 0 THEN 3e0 WHEN 1 THEN 9e0 WHEN 2 THEN 1e0 END AS h FROM v_frame", "v_frame")
def ratio_text(frames):
    text = F.element_at(F.array(*[F.lit(t) for t in ("2:3", "16:9", "1.5:1", "square")]), (F.col("id") % 4 + 1).cast("int"))
    w, h = crops.aspect(text)
    return frames.select("id", w.alias("w"), h.alias("h"))


_AT = "g[(CASE WHEN {1} < 0 THEN 1 WHEN {1} > 31 THEN 30 ELSE {1} END) * 32 + (CASE WHEN {0} < 0 THEN 1 WHEN {0} > 31 THEN 30 ELSE {0} END) + 1]"
_BEND = " + ".join(_AT.format(x, y) for x, y in (("i % 32 - 1", "i // 32"), ("i % 32 + 1", "i // 32"), ("i % 32", "i // 32 - 1"), ("i % 32", "i // 32 + 1"))) + " - 4 * g[i + 1]"


@query(
    f"SELECT id, round(energy, 5) AS energy FROM (SELECT id, (list_sum(list_transform(l, lambda x: x * x)) / 1024e0 - pow(list_sum(l) / 1024e0, 2)) / (pow(list_sum(g) / 1024e0, 2) + 1e-6) AS energy FROM (SELECT id, g, list_transform(range(0, 1024), lambda i: {_BEND}) AS l FROM (SELECT id, {_GRAY} AS g FROM v_vec))) WHERE energy >= 0.05e0",
    "v_vec",
)
def crop_sharpness(vecs):
    """Crops sharp enough by edge energy; the gate is left out where its limit is 0."""
    least = 0.05
    measured = vecs.select("id", F.round(images.edge_energy(_gray(vecs), 32), 5).alias("energy"))
    return measured.where(F.col("energy") >= least) if least > 0 else measured


@query(f"SELECT id, CAST(p AS BIGINT) AS tone, count(*) AS n FROM (SELECT id, unnest({_GRAY}) AS p FROM v_vec) GROUP BY id, p", "v_vec")
def tone_histogram(vecs):
    """How many pixels of each of 256 tones a picture has; tones without a pixel have no row."""
    return vecs.select("id", F.explode(_gray(vecs)).alias("tone")).groupBy("id", F.col("tone").cast("long").alias("tone")).agg(F.count(F.lit(1)).alias("n"))


_SIDE = """concat('{"frames":[{"stream_index":0,"side_data_list":[{"side_data_type":"Display Matrix"}', CASE WHEN id % 3 = 0 THEN ',{"side_data_type":"Mastering display metadata"}' ELSE '' END, ']},{"stream_index":1,"color_transfer":"', CASE WHEN id % 4 = 0 THEN 'SMPTE2084' ELSE 'bt709' END, '"}', CASE WHEN id % 5 = 0 THEN ',{"side_data_list":[{"side_data_type":"CTA 861-3"}]}' ELSE '' END, ']}')"""
_SIDE_ROWS = """SELECT id, 0 AS stream, 'Display Matrix' AS kind FROM v_frame UNION ALL SELECT id, 0, 'Mastering display metadata' FROM v_frame WHERE id % 3 = 0
UNION ALL SELECT id, 1, 'frame color_transfer smpte2084' FROM v_frame WHERE id % 4 = 0 UNION ALL SELECT id, NULL, 'CTA 861-3' FROM v_frame WHERE id % 5 = 0"""


def _side_rows(frames):
    return probe.side_data(frames.select("id", F.from_json(F.expr(_SIDE), probe.FRAMES)["frames"].alias("frames")), ["id"])


@query(_SIDE_ROWS, "v_frame")
def side_data_rows(frames):
    """Side data of the first frames as rows; a frame's HDR transfer counts as one."""
    return _side_rows(frames)


@query(f"SELECT a.id, s AS stream, count(b.kind) AS n FROM v_frame a CROSS JOIN (VALUES (0), (1)) t(s) LEFT JOIN ({_SIDE_ROWS}) b ON a.id = b.id AND (b.stream = s OR b.stream IS NULL) GROUP BY a.id, s", "v_frame")
def side_data_join(frames):
    """Side data of each stream: that of its own index, and what names no stream. The file is the join's key."""
    streams = frames.select(F.col("id").alias("file"), F.explode(F.array(F.lit(0), F.lit(1))).alias("index"))
    met = streams.join(_side_rows(frames), (F.col("file") == F.col("id")) & ((F.col("stream") == F.col("index")) | F.col("stream").isNull()), "left")
    return met.groupBy("file", "index").agg(F.count("kind").alias("n")).select(F.col("file").alias("id"), F.col("index").alias("stream"), "n")


@query(
    "SELECT id, CASE WHEN id % 3 = 0 THEN 25e0 WHEN id % 4 = 1 THEN 24e0 ELSE 30e0 END AS rate, CASE WHEN id % 5 <> 0 THEN id % 900 + 1 WHEN id % 7 = 0 THEN 77 WHEN id % 4 = 1 THEN CAST(floor((id % 50) / 4e0 * 24 + 0.5e0) AS BIGINT) ELSE 0 END AS total FROM v_frame",
    "v_frame",
)
def rate_total(frames):
    """Frame rate and count from two probes, either of which may lack either."""
    i = F.col("id")
    rate, total = probe.rate_and_total(
        F.when(i % 3 == 0, 25.0).otherwise(0.0), F.when(i % 5 != 0, i % 900 + 1), F.when(i % 4 == 1, 24.0), F.when(i % 7 == 0, F.lit(77).cast("long")), (i % 50) / 4.0,
    )
    return frames.select("id", rate.alias("rate"), total.alias("total"))


@query(
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'v:0' WHEN id % 5 = 0 THEN 'v' WHEN id % 7 = 0 THEN 'any' END AS selector, CASE WHEN id % 2 = 0 AND id % 13 <> 0 THEN 'p010 pipe' END AS reader FROM v_frame",
    "v_frame",
)
def probe_choice(frames):
    """The first of three probe results that lists a stream, and the reader that hands HDR on untouched."""
    doc = lambda by: F.when(F.col("id") % by == 0, '{"streams":[{"index":0}]}').when(F.col("id") % 2 == 0, '{"streams":[]}')
    listed = lambda text: F.size(F.from_json(text, probe.STREAMS)["streams"]) > 0
    selector = F.coalesce(*[F.when(listed(doc(by)), name) for by, name in ((3, "v:0"), (5, "v"), (7, "any"))])
    return frames.select("id", selector.alias("selector"), probe.passthrough(F.col("id") % 2 == 0, F.col("id") % 13 != 0).alias("reader"))


@query(
    """SELECT video_id, CASE WHEN video_id % 7 = 0 THEN 'stream transfer arib-std-b67' ELSE coalesce((SELECT arg_min(concat('frame ', frame_idx, ' transfer smpte2084'), frame_idx) FROM v_frame b WHERE b.video_id = a.video_id AND frame_idx < 12 AND id % 17 = 0), 'none') END AS reason
FROM (SELECT DISTINCT video_id FROM v_frame) a""",
    "v_frame",
)
def embedded_hdr(frames):
    """HDR by a stream's own signals, else by those of its first twelve frames; the earliest gives the reason."""
    transfer = F.when(F.col("id") % 17 == 0, "AVColorTransfer.SMPTE2084")
    early = F.when((F.col("frame_idx") < 12) & probe.plain_name(transfer).isin(probe.HDR_TRANSFERS), F.concat(F.lit("frame "), F.col("frame_idx"), F.lit(" transfer "), probe.plain_name(transfer)))
    of_stream = F.when(F.col("video_id") % 7 == 0, "arib-std-b67")
    found = frames.groupBy("video_id").agg(F.min_by(early, F.when(early.isNotNull(), F.col("frame_idx"))).alias("early"))
    return found.select("video_id", F.coalesce(F.when(of_stream.isin(probe.HDR_TRANSFERS), F.concat(F.lit("stream transfer "), of_stream)), F.col("early"), F.lit("none")).alias("reason"))


@query("SELECT id, id % 4 IN (0, 1) AS wide, id % 3 = 0 OR id % 10 >= 8 AS deep, id % 5 IN (1, 2) AS hlg FROM v_frame", "v_frame")
def stream_strings(frames):
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % by + 1).cast("int"))
    wide = probe.is_wide(pick(["BT2020nc", "bt.2020", "bt709", None], 4))
    deep = probe.is_deep(pick(["yuv420p10le", "yuv420p", None], 3), F.col("id") % 10 + 2)
    return frames.select("id", wide.alias("wide"), deep.alias("deep"), probe.is_hlg(pick(["bt709", "ARIB-STD-B67", "Transfer.HLG", None, "unknown"], 5)).alias("hlg"))


_FD7 = f"1 - {DOT} / (greatest({_A}, 1e-6) * greatest({_B}, 1e-6))"


@query(
    f"""SELECT person, CASE WHEN count(d) > 0 THEN arg_min(id, d) ELSE arg_max(id, q * 1e9 + area * 1e6 - id) END AS face, floor(min(d) * 1e6 + 0.5e0) / 1e6 AS fd
FROM (SELECT a.id, CAST(floor(a.id / 3e0) AS BIGINT) AS person, a.q, a.id % 50 AS area, CASE WHEN a.id % 4 = 0 AND floor(a.id / 3e0) % 2 = 0 OR floor(a.id / 3e0) % 5 = 0 THEN NULL ELSE {_FD7} END AS d FROM v_vec a JOIN v_vec b ON b.id = 7) GROUP BY person""",
    "v_vec",
)
def nearest_face(vecs):
    """Of each person's faces the nearest to the reference; where none has a vector, the one of best quality, then area."""
    person = F.floor(F.col("id") / 3).cast("long")
    bare = ((F.col("id") % 4 == 0) & (person % 2 == 0)) | (person % 5 == 0)
    ref = vecs.where("id = 7").select(F.col("embedding").alias("ref")).limit(1)
    faces = vecs.select("id", "q", person.alias("person"), F.when(~bare, F.col("embedding")).alias("feat")).crossJoin(F.broadcast(ref))
    known = F.when(F.col("feat").isNotNull(), vectors.face_distance(F.col("feat"), F.col("ref")))
    best = faces.withColumn("d", known).groupBy("person").agg(
        F.min_by("id", F.when(F.col("d").isNotNull(), F.struct("d", "id"))).alias("near"), F.min("d").alias("d"),
        F.min_by("id", F.struct(-F.col("q"), -(F.col("id") % 50), F.col("id"))).alias("best"),
    )
    return best.select("person", F.coalesce("near", "best").alias("face"), _fixed(F.col("d")).alias("fd"))


@query("SELECT a.frame, a.id, b.conf AS face_conf, b.id IS NOT NULL AS has_face FROM v_person a LEFT JOIN v_person b ON a.frame = b.frame AND a.id = b.id AND b.conf >= 0.6e0", "v_person")
def face_map(boxes):
    """Each person with its face, if it has one."""
    faces = boxes.where("conf >= 0.6").select("frame", "id", F.col("conf").alias("face_conf"))
    return boxes.select("frame", "id").join(faces, ["frame", "id"], "left").select("frame", "id", "face_conf", F.col("face_conf").isNotNull().alias("has_face"))


_CX, _CY = "((x1 + x2) / 2e0 - 240e0)", "((y1 + y2) / 2e0 - 135e0)"
_FAR = f"sqrt({_CX} * {_CX} + {_CY} * {_CY})"


@query(f"SELECT frame, id FROM v_person QUALIFY row_number() OVER (PARTITION BY frame ORDER BY CASE WHEN frame % 5 = 0 THEN -{_FAR} ELSE 0.7e0 * conf - 0.3e0 * {_FAR} / sqrt(303300e0) END DESC, id) = 1", "v_person")
def central_pick(boxes):
    """In each frame the sure and central candidate; where confidence is missing, the most central."""
    conf = F.when(F.col("frame") % 5 != 0, F.col("conf"))
    score = scores.central_score(conf, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, 480.0, 270.0)
    return boxes.groupBy("frame").agg(F.min_by("id", F.struct(-score, F.col("id"))).alias("id"))


@query(
    "SELECT face, floor(m[1] / (n + 1e-10) * 1e6 + 0.5e0) / 1e6 AS first, floor(n * 1e6 + 0.5e0) / 1e6 AS norm FROM (SELECT face, m, sqrt(list_dot_product(m, m)) AS n FROM (SELECT CAST(floor(a.id / 2e0) AS BIGINT) AS face, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE + coalesce(b.embedding[i]::DOUBLE, 0e0)) AS m FROM v_vec a LEFT JOIN v_vec b ON b.id = a.id + 1 WHERE a.id % 2 = 0))",
    "v_vec",
)
def flip_sum(vecs):
    """The embeddings of a face and of its mirror image added up; a group has two rows at most."""
    both = vecs.groupBy(F.floor(F.col("id") / 2).cast("long").alias("face")).agg(F.array_sort(F.collect_list(F.struct("id", "embedding"))).alias("rows"))
    summed = both.select("face", vectors.total(F.transform("rows", lambda r: r["embedding"])).alias("m"))
    return summed.select("face", _fixed(vectors.unit(F.col("m"))[0]).alias("first"), _fixed(vectors.norm(F.col("m"))).alias("norm"))


@query("SELECT id, (frame_idx % 6 = 0) AS heavy, arg AS stage FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'upright' WHEN id % 5 = 0 THEN 'scaled' WHEN id % 7 = 0 THEN 'turned' ELSE 'none' END AS arg FROM v_frame)", "v_frame")
def detection_stage(frames):
    """The first stage that found anything, over stages computed before, and the frames of the heavy cadence."""
    stage = F.coalesce(*[F.when(F.col("id") % by == 0, name) for name, by in (("upright", 3), ("scaled", 5), ("turned", 7))], F.lit("none"))
    return frames.select("id", (F.pmod("frame_idx", F.lit(6)) == 0).alias("heavy"), stage.alias("stage"))


@query(f"SELECT id, least(c, 0.2e0) AS probe, {FIXED.format("greatest(0.1e0, c * CASE WHEN id % 4 IN (1, 3) THEN 0.8e0 ELSE 0.6e0 END)")} AS turned FROM (SELECT id, (id % 90) / 100e0 AS c FROM v_frame)", "v_frame")
def confidence_steps(frames):
    base = (F.col("id") % 90) / 100.0
    return frames.select("id", scores.probe_confidence(base).alias("probe"), _fixed(scores.turned_confidence(base, (F.col("id") % 4) * 90)).alias("turned"))


_SPREAD = 0x1111111111111111


@query(
    f"""WITH RECURSIVE o AS (SELECT *, CAST({HASH} & {_SPREAD} AS BIGINT) AS p, row_number() OVER (ORDER BY q DESC, id) AS n FROM v_vec),
w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS ids, []::BIGINT[] AS kept
  UNION ALL SELECT w.n + 1, CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, a.p)) <= 3)) > 0 THEN w.ids ELSE list_append(w.ids, a.id) END,
    CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, a.p)) <= 3)) > 0 THEN w.kept ELSE list_append(w.kept, a.p) END FROM w JOIN o a ON a.n = w.n + 1)
SELECT unnest(ids) AS id FROM w WHERE n = (SELECT max(n) FROM o)""",
    "v_vec",
)
def dedup_global(vecs):
    """Near copies dropped over all rows in order of quality, without a group that holds them all."""
    hashed = vecs.select((-F.col("q")).alias("order"), "id", vectors.sign_hash("embedding").bitwiseAND(F.lit(_SPREAD)).alias("hash"))
    return greedy.drop_near_hashes_everywhere(hashed, ["order", "id"], "hash", 3).select("id")


@query(
    """SELECT frame, id, printf('%.3f', frame / 25e0) AS time_secs, printf('%.4f', CASE WHEN f IS NULL THEN r WHEN r IS NULL THEN f ELSE least(f, r) END) AS score, coalesce(printf('%.4f', f), '') AS face_dist, coalesce(printf('%.4f', r), '') AS reid_dist,
CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2, printf('f%08d.jpg', frame) AS crop_path
FROM (SELECT *, CASE WHEN id % 4 <> 0 THEN (id * 13 % 100) / 128e0 END AS f, CASE WHEN id % 3 <> 0 THEN (id * 29 % 100) / 256e0 END AS r FROM v_person) WHERE coalesce(f <= 0.45e0, false) OR coalesce(r <= 0.2e0, false)""",
    "v_person",
)
def hit_rows(boxes):
    """The hit index with all its columns; a missing distance is an empty text."""
    i, frame = F.col("id"), F.col("frame")
    f, r = F.when(i % 4 != 0, (i * 13 % 100) / 128.0), F.when(i % 3 != 0, (i * 29 % 100) / 256.0)
    four = lambda c: F.coalesce(F.when(c.isNotNull(), scores.decimals(c, 4)), F.lit(""))
    return boxes.where(scores.accepted(f, r, 0.45, 0.2)).select(
        "frame", "id", scores.decimals(frame / 25.0, 3).alias("time_secs"), four(scores.combined(f, r)).alias("score"), four(f).alias("face_dist"), four(r).alias("reid_dist"),
        *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], F.format_string("f%08d.jpg", frame).alias("crop_path"),
    )


_N = "row_number() OVER (ORDER BY quality DESC, face_fd, path)"


@query(f"SELECT {_N} AS rank, path AS file, printf('%04d.jpg', {_N}) AS dst_file, face_fd, sharpness, exposure, face_frac, yaw, wmark AS roll, ratio, quality, category, CASE WHEN abs(yaw) >= 50 THEN 1 ELSE 0 END AS is_profile FROM ({RANKED}) WHERE wmark < 0.5e0")
def manifest_rows(items):
    """The manifest with all its columns, numbered over what was written: at most the sum of the categories' caps."""
    n = F.row_number().over(Window.orderBy(F.desc("quality"), "face_fd", "path"))
    return _ranked(items).where("wmark < 0.5").select(
        n.alias("rank"), F.col("path").alias("file"), F.format_string("%04d.jpg", n).alias("dst_file"), "face_fd", "sharpness", "exposure", "face_frac", "yaw",
        F.col("wmark").alias("roll"), "ratio", "quality", "category", (F.abs("yaw") >= 50).cast("int").alias("is_profile"),
    )


@query(
    f"SELECT {_N} AS rank, path AS file, CAST(w AS BIGINT) AS scene, category, printf('%.6f', quality) AS quality_used, printf('%.6f', wmark) AS redundancy, printf('%.6f', quality - 0.3e0 * wmark) AS mmr_score, CASE WHEN abs(yaw) >= 50 THEN 1 ELSE 0 END AS is_profile FROM ({RANKED}) a WHERE NOT EXISTS (SELECT 1 FROM v_item b WHERE b.path = a.path AND b.wmark >= 0.3e0)"
)
def selection_rows(items):
    """The log of picks without files that were skipped, numbered anew."""
    n = F.row_number().over(Window.orderBy(F.desc("quality"), "face_fd", "path"))
    kept = _ranked(items).join(items.where("wmark >= 0.3").select("path"), "path", "left_anti")
    six = lambda c: scores.decimals(c, 6)
    return kept.select(
        n.alias("rank"), F.col("path").alias("file"), F.col("w").cast("long").alias("scene"), "category", six(F.col("quality")).alias("quality_used"), six(F.col("wmark")).alias("redundancy"),
        six(F.col("quality") - 0.3 * F.col("wmark")).alias("mmr_score"), (F.abs("yaw") >= 50).cast("int").alias("is_profile"),
    )


@query(f"SELECT path AS file, CAST(w AS BIGINT) AS scene, id / 1e0 AS ts, quality, category, CASE WHEN abs(yaw) >= 50 THEN 1 ELSE 0 END AS is_profile FROM ({RANKED})")
def scene_rows(items):
    """The log of scenes: a row for each pick."""
    return _ranked(items).select(F.col("path").alias("file"), F.col("w").cast("long").alias("scene"), F.col("id").cast("double").alias("ts"), "quality", "category", (F.abs("yaw") >= 50).cast("int").alias("is_profile"))


@query(
    f"""SELECT name, n, row_number() OVER (ORDER BY coalesce(nullif(list_position(['closeup', 'portrait', 'cowboy', 'full', 'wide'], name), 0), CASE WHEN name = 'profile' THEN 99 ELSE 50 END), name) AS place
FROM (SELECT {CATEGORY} AS name, count(*) AS n FROM v_item GROUP BY 1 UNION ALL SELECT 'profile', count(*) FROM v_item WHERE abs(yaw) >= 50)"""
)
def summary_counters(items):
    """Counts by category in a fixed order, others after them by name, profiles last: a handful of rows to number."""
    counted = _classed(items).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("yaw") >= 50).alias("p"))
    rows = counted.select(F.col("category").alias("name"), "n").unionByName(counted.agg(F.sum("p").alias("n")).select(F.lit("profile").alias("name"), "n"))
    known = F.array(*[F.lit(c) for c in ("closeup", "portrait", "cowboy", "full", "wide")])
    key = F.coalesce(F.nullif(F.array_position(known, F.col("name")), F.lit(0).cast("long")), F.when(F.col("name") == "profile", 99).otherwise(50))
    return rows.select("name", "n", F.row_number().over(Window.orderBy(key, "name")).alias("place"))


@query(f"SELECT CAST(w AS BIGINT) AS scene, count(*) AS n, count(*) FILTER (WHERE face_fd <= 0.45e0 AND sharpness >= 0.10e0) AS kept, floor(max({Q}) * 1e6 + 0.5e0) / 1e6 AS best FROM v_item GROUP BY w")
def scene_counts(items):
    """Rows of each scene, and how many passed the gate."""
    scored = _classed(items)
    return scored.groupBy(F.col("w").cast("long").alias("scene")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("face_fd") <= 0.45) & (F.col("sharpness") >= 0.10)).alias("kept"), _fixed(F.max("quality")).alias("best"))


@query(
    "SELECT frame, least(1e0, count(*) FILTER (WHERE (x1 < 59 OR x2 > 421) AND (y1 < 59 OR y1 + h > 211) AND (x2 - x1) / (h + 1e-6) BETWEEN 1.5e0 AND 12e0 AND (x2 - x1) * h >= 80) / 25e0) AS score FROM (SELECT *, (y2 - y1) / 4e0 AS h FROM v_person) GROUP BY frame",
    "v_person",
)
def corner_text(boxes):
    """How much of a picture's corners looks like text, from regions found before."""
    h = (F.col("y2") - F.col("y1")) / 4
    mark = geometry.corner_marks(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), h, 480.0, 270.0)
    return boxes.groupBy("frame").agg(F.least(F.lit(1.0), F.count_if(mark) / 25).alias("score"))


@query("SELECT path, CASE id % 4 WHEN 0 THEN (id % 100) + 0.5e0 WHEN 1 THEN 100.0 + id % 900 WHEN 2 THEN 100.0 + id % 900 END AS ts FROM v_item")
def ts_patterns(items):
    """Times from names of each pattern: seconds, a frame number, the last long run of digits, or none."""
    i, number = F.col("id"), (100 + F.col("id") % 900).cast("string")
    name = F.when(i % 4 == 0, F.concat(F.lit("clip_t"), (i % 100).cast("string"), F.lit(".5s_f00012345.jpg"))).when(i % 4 == 1, F.concat(F.lit("555 IMG_"), number, F.lit("_1234.jpg"))).when(i % 4 == 2, F.concat(F.lit("shot 7777-"), number, F.lit("b12.jpg"))).otherwise(F.lit("a12.jpg"))
    return items.select("path", scores.time_from_name(name).alias("ts"))


_MA, _MB = (f"list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-6) * {w})" for w in ("0.6e0", "1.0e0"))


@query(
    """SELECT id, size, floor(m[1] / (n + 1e-6) * 1e6 + 0.5e0) / 1e6 AS first, floor(m[40] / (n + 1e-6) * 1e6 + 0.5e0) / 1e6 AS fortieth FROM (SELECT id, m, CAST(len(m) AS INTEGER) AS size, sqrt(list_dot_product(m, m)) AS n FROM (SELECT id,
list_transform(range(1, (CASE WHEN id % 3 = 1 THEN 33 ELSE 65 END)), lambda i: CASE WHEN id % 3 = 1 THEN 0e0 ELSE a[i]::DOUBLE / (na + 1e-6) * 0.6e0 END + CASE WHEN id % 3 = 2 OR i > 32 THEN 0e0 ELSE b[i]::DOUBLE / (nb + 1e-6) END) AS m
FROM (SELECT id, a, b, sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) AS na, sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])) AS nb FROM (SELECT id, embedding AS a, embedding[33:64] AS b FROM v_vec WHERE id % 7 <> 0))))
UNION ALL SELECT id, NULL, NULL, NULL FROM v_vec WHERE id % 7 = 0""",
    "v_vec",
)
def mix_vectors(vecs):
    """A face vector of weight 0.6 and a shorter background of weight 1; either or both may be missing."""
    i, e = F.col("id"), F.col("embedding")
    face, ground = F.when((i % 3 != 1) & (i % 7 != 0), e), F.when((i % 3 != 2) & (i % 7 != 0), F.slice(e, 33, 32))
    made = vecs.select("id", vectors.mixed(face, ground, 0.6, 1.0).alias("m"))
    return made.select("id", F.when(F.col("m").isNotNull(), F.size("m")).alias("size"), _fixed(F.get("m", F.lit(0))).alias("first"), _fixed(F.get("m", F.lit(39))).alias("fortieth"))


@query(
    f"SELECT path, {FIXED.format('greatest(0e0, least(1e0, (0.45e0 * greatest(0e0, least(1e0, 1 - greatest(0e0, face_fd) / 0.5e0)) + 0.30e0 * sharpness + 0.20e0 * exposure + 0.05e0 * least(1e0, face_quality / 1200e0)) * greatest(0e0, 1 - 0.6e0 * wmark) * greatest(0e0, 1 - 0.6e0 * least(0.4e0, (id % 60) / 100e0))))')} AS quality FROM v_item"
)
def quality_with_border(items):
    """Quality with a penalty for dark borders, which counts up to 0.4."""
    c = F.col
    return items.select("path", _fixed(scores.quality(c("face_fd"), c("sharpness"), c("exposure"), c("face_quality"), c("wmark"), (c("id") % 60) / 100.0)).alias("quality"))


@query(f"SELECT path, {RATIO} AS ratio FROM (SELECT path, CAST(id % 37 + 3 AS DOUBLE) AS w, CAST(id % 23 + 3 AS DOUBLE) AS h FROM v_item)")
def ratio_all_classes(items):
    """Ratio classes over sizes that reach each of them, the gaps between classes too."""
    w, h = (F.col("id") % 37 + 3).cast("double"), (F.col("id") % 23 + 3).cast("double")
    return items.select("path", scores.ratio_class(w, h).alias("ratio"))


@query("SELECT id, x1, y1, x2, y2 FROM (SELECT id, 0e0 AS x1, 0e0 AS y1, 0e0 AS x2, 0e0 AS y2 FROM v_person WHERE false) UNION ALL SELECT id, floor(least((y1 - 3) / 2, (y2 - 3) / 2)), floor(least(-(x1 - 5), -(x2 - 5))), ceil(greatest((y1 - 3) / 2, (y2 - 3) / 2)), ceil(greatest(-(x1 - 5), -(x2 - 5))) FROM v_person", "v_person")
def affine_turn(boxes):
    """Boxes taken back through a quarter turn with scale and shift."""
    back = crops.affine_box((0.0, -1.0, 5.0, 2.0, 0.0, 3.0), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return boxes.select("id", *[b.cast("double").alias(c) for b, c in zip(back, ("x1", "y1", "x2", "y2"))])


@query("SELECT id, frame_idx FROM (SELECT *, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS before, lag(rd) OVER (PARTITION BY video_id ORDER BY frame_idx) AS rd0 FROM v_frame) WHERE fd >= 9 AND rd <= 0.4e0 AND frame_idx - before <= 2 AND abs(rd - rd0) <= 0.5e0", "v_frame")
def faceless_persistence(frames):
    """Proposed: frames without a face that go on from the frame before by body alone."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    led = frames.withColumn("before", F.lag("frame_idx").over(w)).withColumn("rd0", F.lag("rd").over(w))
    return led.where("fd >= 9 AND rd <= 0.4 AND frame_idx - before <= 2 AND abs(rd - rd0) <= 0.5").select("id", "frame_idx")


@query(f"SELECT a.id FROM v_vec a WHERE NOT EXISTS (SELECT 1 FROM v_vec b WHERE b.id IN (3, 11, 19) AND {DOT} / (({_A} + 1e-6) * ({_B} + 1e-6)) >= 0.2e0)", "v_vec")
def negatives(vecs):
    """Proposed: rows not near any negative example; the examples are three rows."""
    bad = vecs.where(F.col("id").isin(3, 11, 19)).select(F.col("embedding").alias("bad")).limit(3)
    return vecs.join(F.broadcast(bad), vectors.cosine(F.col("embedding"), F.col("bad")) >= 0.2, "left_anti").select("id")


@query("SELECT video_id, frame_idx, id, CASE WHEN last_hit IS NULL OR frame_idx - last_hit > 3 THEN NULL ELSE last_hit END AS locked_on FROM (SELECT *, max(CASE WHEN fd <= 0.45e0 THEN frame_idx END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_hit FROM v_frame)", "v_frame")
def lock_region(frames):
    """Proposed: the hit whose surroundings are searched first; it is dropped after three frames without another."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("fd") <= 0.45, F.col("frame_idx"))).over(w)
    return frames.withColumn("last", last).select("video_id", "frame_idx", "id", F.when(F.col("frame_idx") - F.col("last") <= 3, F.col("last")).alias("locked_on"))


@query(f"SELECT a.id, CASE WHEN a.id % 6 <> 0 THEN {FIXED.format(f'1 - {DOT} / ({_A} * {_B})')} END AS distance FROM v_vec a JOIN v_vec b ON b.id = 7", "v_vec")
def body_distance(vecs):
    """Distance of bodies to one reference, which is a single row; null for a vector without length."""
    e = F.when(F.col("id") % 6 != 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: x * 0))
    ref = vecs.where("id = 7").select(F.col("embedding").alias("ref")).limit(1)
    return vecs.crossJoin(F.broadcast(ref)).select("id", _fixed(vectors.plain_distance(e, F.col("ref"))).alias("distance"))


@query(
    """SELECT id, CASE WHEN s2 >= s3 AND s2 >= s1 THEN '2:3' WHEN s3 >= s1 THEN '3:4' ELSE '1:1' END AS ratio FROM (SELECT id, CASE WHEN w / h < 2e0 / 3e0 THEN w / (h * (2e0 / 3e0)) ELSE h * (2e0 / 3e0) / w END AS s2, CASE WHEN w / h < 0.75e0 THEN w / (h * 0.75e0) ELSE h * 0.75e0 / w END AS s3, CASE WHEN w / h < 1e0 THEN w / (h * 1e0) ELSE h * 1e0 / w END AS s1 FROM (SELECT id, x2 - x1 AS w, y2 - y1 AS h FROM v_person))""",
    "v_person",
)
def crop_choice(boxes):
    """Proposed: the ratio whose crop the box fills best; the first of equal ones."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    offers = F.array(*[F.struct((-crops.kept_share(w, h, r)).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, r) in enumerate((("2:3", 2 / 3), ("3:4", 0.75), ("1:1", 1.0)))])
    return boxes.select("id", F.array_min(offers)["name"].alias("ratio"))


@query(
    f"""WITH RECURSIVE p AS (SELECT * REPLACE (CAST(floor(id / 40e0) AS BIGINT) AS frame) FROM v_person WHERE conf >= 0.35e0),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, id) AS n FROM p),
w AS (SELECT frame, 0::BIGINT AS n, []::BIGINT[] AS kept FROM o GROUP BY frame
  UNION ALL SELECT w.frame, w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE b.frame = a.frame AND list_contains(w.kept, b.id) AND {IOU} >= 0.45e0) THEN w.kept ELSE list_append(w.kept, a.id) END
  FROM w JOIN o a ON a.frame = w.frame AND a.n = w.n + 1)
SELECT frame, unnest(kept[1:40]) AS id FROM w WHERE n = (SELECT max(n) FROM o WHERE o.frame = w.frame)""",
    "v_person",
)
def person_detections(boxes):
    """Persons sure enough, without overlapping ones, at most 40 a frame."""
    found = boxes.where("conf >= 0.35").withColumn("frame", F.floor(F.col("id") / 40).cast("long")).withColumn("order", -F.col("conf"))
    kept = greedy.suppress_boxes(found, ["frame"], ["order", "id"])
    n = F.row_number().over(Window.partitionBy("frame").orderBy("order", "id"))
    return kept.withColumn("n", n).where("n <= 40").select("frame", "id")


@query(
    """SELECT id, locked, coalesce(fd <= CASE WHEN locked THEN 0.35e0 ELSE 0.45e0 END, false) AS accepted FROM (SELECT *, coalesce(sum(CASE WHEN fd <= 0.45e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) >= 2 AS locked FROM v_frame)""",
    "v_frame",
)
def temporal_lock(frames):
    """Proposed: after two hits among the five frames before, a stricter distance is asked."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(-5, -1)
    locked = F.coalesce(F.count_if(F.col("fd") <= 0.45).over(w), F.lit(0)) >= 2
    return frames.withColumn("locked", locked).select("id", "locked", F.coalesce(F.col("fd") <= F.when(F.col("locked"), 0.35).otherwise(0.45), F.lit(False)).alias("accepted"))
