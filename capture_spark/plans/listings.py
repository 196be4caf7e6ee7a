"""Registered queries of the listing operators, each with a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capture_spark.operators import listings
from capture_spark.plans.captures import add


def _resolve(frames: DataFrame, named: DataFrame) -> DataFrame:
    files = named.select("scene_id", F.concat(F.lit("images/"), F.regexp_replace("file_name", "jpg$", "png")).alias("file_path"))
    bare = F.when(F.col("camera_id") == 0, F.col("file_path")).otherwise(F.regexp_replace("file_path", r"\.png$", ""))
    found = listings.resolve_images(frames.select("scene_id", "frame_id", bare.alias("file_path")), files)
    return found.groupBy("scene_id").agg(F.count("image_path").alias("found"), F.count_if(F.col("image_path").isNull()).alias("skipped"))


def _lists(frames: DataFrame) -> DataFrame:
    split = F.when(F.col("frame_id") % 2 == 0, "train").otherwise("val")
    name = F.when(F.col("frame_id") % 7 == 0, F.concat("file_path", F.lit(".missing"))).otherwise(F.col("file_path"))
    return frames.select("scene_id", split.alias("split"), name.alias("file_path"))


add("j07_resolve_images", "frames named", _resolve, "scene_id found skipped", "",
    "SELECT f.scene_id, count(n.file_name) AS found, count(*) - count(n.file_name) AS skipped FROM frames f LEFT JOIN named n ON f.scene_id = n.scene_id AND f.file_path = 'images/' || replace(n.file_name, 'jpg', 'png') GROUP BY f.scene_id")
add("j11_listed_frames", "frames", lambda f: listings.listed_frames(f, _lists(f)), "scene_id split kept absent", "",
    """SELECT l.scene_id, split, count(f.frame_id) AS kept, count(*) - count(f.frame_id) AS absent FROM (SELECT scene_id, CASE WHEN frame_id % 2 = 0 THEN 'train' ELSE 'val' END AS split,
 CASE WHEN frame_id % 7 = 0 THEN file_path || '.missing' ELSE file_path END AS file_path FROM frames) l LEFT JOIN frames f ON l.scene_id = f.scene_id AND l.file_path = f.file_path GROUP BY ALL""")
add("j21_split_by_names", "frames", lambda f: listings.split_by_names(f, _lists(f).filter("split = 'val'")), "scene_id frame_id split", "",
    "SELECT scene_id, frame_id, CASE WHEN frame_id % 2 <> 0 AND frame_id % 7 <> 0 THEN 'eval' ELSE 'train' END AS split FROM frames")
add("a10_match_summary", "frames", lambda f: listings.match_summary(f.groupBy("scene_id").agg(F.count("*").alias("initial"), F.count_if(F.col("blur_score") >= 40).alias("matched"))), "scene_id initial matched grade", "ratio",
    "SELECT *, CASE WHEN ratio = 1 THEN 'all' WHEN ratio < 0.4 THEN 'few' WHEN ratio < 0.8 THEN 'some' ELSE 'most' END AS grade FROM (SELECT *, CAST(matched AS DOUBLE) / initial AS ratio FROM (SELECT scene_id, count(*) AS initial, count(*) FILTER (WHERE blur_score >= 40) AS matched FROM frames GROUP BY scene_id))")
add("p22_rescale_sensors", "frames cameras", lambda f, c: f.select("scene_id", "frame_id", "camera_id").join(listings.rescale_sensors(c, 1024, 684), ["scene_id", "camera_id"]), "frame_id width height", "fx fy cx cy",
    "SELECT frame_id, 1024 AS width, 684 AS height, fx*(a+b)/2 AS fx, fy*(a+b)/2 AS fy, cx*a AS cx, cy*b AS cy FROM (SELECT *, 1024::DOUBLE/width AS a, 684::DOUBLE/height AS b FROM frames JOIN (SELECT scene_id, camera_id, fx, fy, cx, cy, width, height FROM cameras) k USING (scene_id, camera_id))")
add("a21_frequency_levels", "observations", lambda o: listings.frequency_levels(o, "f2d", 20.0, 2.0, 5), "level n", "",
    "SELECT greatest(least(CAST(round_even(ln(f2d/20.0::DOUBLE)/ln(2.0::DOUBLE), 0) AS BIGINT), 4), 0) AS level, count(*) AS n FROM observations GROUP BY 1")
add("a35_splat_shape", "points3d", lambda p: listings.splat_shape(p.selectExpr("scene_id", "r + 1D AS s0", "g + 1D AS s1", "b + 1D AS s2"), 10.0), "scene_id outliers", "excess",
    "SELECT scene_id, count(*) FILTER (WHERE q > 10) AS outliers, avg(greatest(q, 10.0::DOUBLE) - 10.0::DOUBLE) AS excess FROM (SELECT scene_id, greatest(r, g, b)::DOUBLE AS hi, least(r, g, b)::DOUBLE AS lo, (hi + 1) / (lo + 1) AS q FROM points3d) GROUP BY scene_id")
