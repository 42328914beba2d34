"""Views that give the fixture tables the roles of items, vectors, boxes and frames. The same SQL serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_item": """SELECT concat('f', lpad(cast(l_orderkey AS {string}), 8, '0'), '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', cast(round(l_extendedprice * 100e0) AS bigint), '.jpg') AS path,
  l_orderkey AS id, l_discount * 9e0 AS face_fd, l_quantity / 50e0 AS sharpness, 1e0 - l_tax * 5e0 AS exposure, l_extendedprice / 40e0 AS face_quality, (l_partkey % 60) / 100e0 AS face_frac,
  cast(CASE l_suppkey % 7 WHEN 0 THEN 300 WHEN 1 THEN 390 WHEN 2 THEN 450 WHEN 3 THEN 540 WHEN 4 THEN 600 WHEN 5 THEN 900 ELSE 1080 END AS double) AS w, 600e0 AS h,
  cast((l_partkey % 140) - 70 AS double) AS yaw, (l_linenumber - 1) / 10e0 AS wmark FROM lineitem""",
    "v_vec": "SELECT vec_id AS id, label AS scene_hint, embedding, ((vec_id * 37) % 100) / 100e0 AS q, cast(vec_id AS double) AS ts FROM embeddings",
    "v_person": """SELECT p_partkey AS id, cast(floor(p_partkey / 8e0) AS bigint) AS frame, cast((p_partkey % 2) * 300 + (p_partkey * 7) % 40 AS double) AS x1, cast((p_partkey * 11) % 30 AS double) AS y1,
  cast((p_partkey % 2) * 300 + (p_partkey * 7) % 40 + 120 + p_size * 2 AS double) AS x2, cast((p_partkey * 11) % 30 + 160 + p_size * 2 AS double) AS y2, ((p_partkey * 37) % 100) / 100e0 AS conf FROM part""",
    "v_frame": """SELECT user_id AS video_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  CASE WHEN event_type = 'error' THEN 9e0 ELSE least(value, 90e0) / 100e0 END AS fd, CASE WHEN event_type = 'view' THEN NULL ELSE (event_id % 100) / 100e0 END AS rd FROM events""",
}
TABLES = {"v_item": "lineitem", "v_vec": "embeddings", "v_person": "part", "v_frame": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(string="string").replace(f"FROM {TABLES[name]}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet"))


def with_views(sql: str) -> str:
    """A query over the views as one DuckDB statement."""
    used = ", ".join(f"{k} AS ({v.format(string='varchar')})" for k, v in VIEWS.items() if re.search(rf"\b{k}\b", sql))
    recursive, body = ("WITH RECURSIVE ", sql.removeprefix("WITH RECURSIVE ")) if sql.startswith("WITH RECURSIVE ") else ("WITH ", sql.removeprefix("WITH "))
    return f"{recursive}{used}" + (", " if sql.startswith("WITH ") else " ") + body
