"""Capture tables derived from the given star-schema tables, as one SQL text for Spark and other engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"
VIEWS = {
    "frames": """SELECT o_custkey % 50 AS scene_id, o_orderkey AS frame_id, o_orderkey % 5 AS camera_id,
  concat('images/', CASE WHEN o_orderkey % 10 = 0 THEN 'eval_' ELSE 'train_' END, lpad(CAST(o_orderkey AS STRING), 8, '0'), '.png') AS file_path,
  o_orderdate AS captured_at, o_totalprice / 5000 AS blur_score,
  radians(CAST((o_orderkey * 37) % 360 AS DOUBLE)) AS yaw, radians(CAST((o_orderkey * 17) % 60 - 30 AS DOUBLE)) AS pitch,
  CAST((o_orderkey * 131) % 2001 - 1000 AS DOUBLE) / 100 AS tx, CAST((o_orderkey * 197) % 2001 - 1000 AS DOUBLE) / 100 AS ty, CAST((o_orderkey * 263) % 2001 - 1000 AS DOUBLE) / 100 AS tz
FROM orders""",
    "cameras": """SELECT DISTINCT o_custkey % 50 AS scene_id, CAST(o_orderkey % 5 AS BIGINT) AS camera_id, CAST(500 + (o_orderkey % 5) * 10 + o_custkey % 50 AS DOUBLE) AS fx, CAST(510 + (o_orderkey % 5) * 10 AS DOUBLE) AS fy,
  CAST(320 AS DOUBLE) AS cx, CAST(240 AS DOUBLE) AS cy, 643 AS width, 481 AS height FROM orders""",
    "points3d": """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS point3d_id, p_partkey % 50 AS scene_id, CAST((p_partkey * 7919) % 2001 - 1000 AS DOUBLE) / 100 AS x,
  CAST((p_partkey * 104729) % 2001 - 1000 AS DOUBLE) / 100 AS y, CAST((p_partkey * 1299709) % 2001 - 1000 AS DOUBLE) / 100 AS z,
  (p_partkey * 31) % 256 AS r, (p_partkey * 57) % 256 AS g, (p_partkey * 91) % 256 AS b, CAST(p_size AS DOUBLE) / 10 AS error FROM part""",
    "observations": f"""SELECT o_custkey % 50 AS scene_id, l_orderkey AS image_id, CAST(floor(l_partkey / 50) AS BIGINT) AS point3d_id, CAST({ROW} AS BIGINT) AS point2d_idx, l_quantity * 10 AS u, l_extendedprice / 250 AS v, l_quantity * 16 AS f2d
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ray_samples": f"""SELECT l_orderkey % 3 AS scene_id, CAST(floor(l_orderkey / 3) AS BIGINT) AS ray_id, CAST({ROW} AS BIGINT) AS sample_idx, CAST(2 AS DOUBLE) + CAST({ROW} AS DOUBLE) / 2 AS t_start, CAST(0.5 AS DOUBLE) AS delta,
  l_extendedprice / 50000 AS density, abs(l_discount) * 10 AS r, abs(l_tax) * 12.5 AS g, l_quantity / 50 AS b FROM lineitem""",
    "rays": """SELECT o_orderkey % 3 AS scene_id, CAST(floor(o_orderkey / 3) AS BIGINT) AS ray_id, CAST((o_orderkey * 131) % 2001 - 1000 AS DOUBLE) / 100 AS ox,
  CAST((o_orderkey * 197) % 2001 - 1000 AS DOUBLE) / 100 AS oy, CAST((o_orderkey * 263) % 2001 - 1000 AS DOUBLE) / 100 AS oz,
  cos(radians(CAST((o_orderkey * 17) % 60 - 30 AS DOUBLE))) * cos(radians(CAST((o_orderkey * 37) % 360 AS DOUBLE) + 0.5)) AS dx,
  cos(radians(CAST((o_orderkey * 17) % 60 - 30 AS DOUBLE))) * sin(radians(CAST((o_orderkey * 37) % 360 AS DOUBLE) + 0.5)) AS dy,
  sin(radians(CAST((o_orderkey * 17) % 60 - 30 AS DOUBLE))) AS dz FROM orders""",
    "pixels": """SELECT CAST(floor(o_orderkey / 100) AS BIGINT) % 3 AS scene_id, CAST(floor(o_orderkey / 300) AS BIGINT) AS image_id, CAST(floor(o_orderkey / 300) AS BIGINT) % 5 AS camera_id, CAST(floor((o_orderkey % 100) / 10) AS BIGINT) AS y, o_orderkey % 10 AS x,
  CAST((o_orderkey * 37) % 256 AS DOUBLE) / 255 AS gt, CAST((o_orderkey * 41) % 256 AS DOUBLE) / 255 AS pred, o_orderkey % 7 <> 0 AS mask, o_custkey % 8 AS class_id,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 50000 END AS depth_gt, o_totalprice / 40000 + CAST((o_orderkey * 13) % 10 AS DOUBLE) / 10 AS depth_pred FROM orders""",
    "shots": """SELECT DISTINCT CAST(floor(o_orderkey / 100) AS BIGINT) % 3 AS scene_id, CAST(floor(o_orderkey / 300) AS BIGINT) AS image_id, CAST(floor(o_orderkey / 300) AS BIGINT) % 5 AS camera_id,
  radians(CAST((CAST(floor(o_orderkey / 100) AS BIGINT) * 37) % 360 AS DOUBLE)) AS yaw, radians(CAST((CAST(floor(o_orderkey / 100) AS BIGINT) * 17) % 60 - 30 AS DOUBLE)) AS pitch,
  CAST((CAST(floor(o_orderkey / 100) AS BIGINT) * 131) % 401 - 200 AS DOUBLE) / 100 AS tx, CAST((CAST(floor(o_orderkey / 100) AS BIGINT) * 197) % 401 - 200 AS DOUBLE) / 100 AS ty, CAST((CAST(floor(o_orderkey / 100) AS BIGINT) * 263) % 401 - 200 AS DOUBLE) / 100 AS tz FROM orders""",
    "telemetry": """SELECT user_id AS run_id, event_type AS name, ts, event_id, value, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS step, props FROM events""",
    "hits": "SELECT event_id % 3 AS scene_id, event_id % 50 AS voxel_id, event_id AS view_order, value / 490 AS tsdf FROM events",
    "poses_t": "SELECT user_id % 10 AS scene_id, ts AS pose_ts, event_id AS pose_id FROM events WHERE event_type = 'view'",
    "captures_t": "SELECT user_id % 10 AS scene_id, ts AS capture_ts, event_id AS capture_id FROM events WHERE event_type = 'click'",
    "visits": "SELECT o_custkey AS key, min(o_totalprice) AS least FROM orders GROUP BY o_custkey",
    "people": "SELECT c_custkey AS key FROM customer",
    "named": """SELECT DISTINCT o_custkey % 50 AS scene_id, concat('train_', lpad(CAST(l_orderkey AS STRING), 8, '0'), '.jpg') AS file_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "annotations": "SELECT user_id AS instance_id, event_id AS annotation_id, CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value / 500 END AS speed FROM events",
}
TABLES = ("orders", "lineitem", "part", "events", "customer", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """The same SQL with the derived views that it names before it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    rest = sql.strip()
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named)
    return f"WITH {head}, {rest[4:]}" if rest[:5].upper() == "WITH " else f"WITH {head} {rest}"
