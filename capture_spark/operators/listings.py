"""Frames against lists of files, splits by name lists, registration counts, sensor sizes, level buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_images(frames: DataFrame, files: DataFrame, extension: str = ".png") -> DataFrame:
    """Add ``image_path``: the frame's path where such a file is listed, else path and extension, else null."""
    names = files.select("scene_id", F.col("file_path").alias("image_path")).distinct()
    tries = frames.withColumn("image_path", F.explode(F.array("file_path", F.concat("file_path", F.lit(extension)))))
    found = tries.join(names, ["scene_id", "image_path"])
    best = found.groupBy("scene_id", "frame_id").agg(F.min_by("image_path", F.length("image_path")).alias("image_path"))
    return frames.join(best, ["scene_id", "frame_id"], "left")


def listed_frames(frames: DataFrame, lists: DataFrame) -> DataFrame:
    """Per scene and list: names that frames have, and names listed but absent (any is an error for the caller)."""
    have = frames.select("scene_id", "file_path", F.lit(1).alias("have")).distinct()
    both = lists.select("scene_id", "split", "file_path").distinct().join(have, ["scene_id", "file_path"], "left")
    return both.groupBy("scene_id", "split").agg(F.count("have").alias("kept"), F.count_if(F.col("have").isNull()).alias("absent"))


def split_by_names(frames: DataFrame, tests: DataFrame) -> DataFrame:
    """Add ``split``: eval for frames whose path is among the scene's test names, else train."""
    marked = tests.select("scene_id", "file_path", F.lit("eval").alias("split")).distinct()
    return frames.join(marked, ["scene_id", "file_path"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def match_summary(scenes: DataFrame) -> DataFrame:
    """Add the share of initial frames that were matched, and its class; null both where there were none."""
    ratio = F.try_divide("matched", "initial")
    grade = F.when(ratio == 1, "all").when(ratio < 0.4, "few").when(ratio < 0.8, "some").when(ratio.isNotNull(), "most")
    return scenes.withColumns({"ratio": ratio, "grade": grade})


def rescale_sensors(cameras: DataFrame, width: int, height: int) -> DataFrame:
    """Sensors at a target size, turned for upright ones; focal lengths times the mean of both scales."""
    wide = F.col("width") > F.col("height")
    w, h = F.when(wide, width).otherwise(height), F.when(wide, height).otherwise(width)
    sx, sy = w / F.col("width"), h / F.col("height")
    new = {"fx": F.col("fx") * (sx + sy) / 2, "fy": F.col("fy") * (sx + sy) / 2, "cx": F.col("cx") * sx, "cy": F.col("cy") * sy}
    return cameras.withColumns({**new, "width": w, "height": h})


def frequency_levels(patches: DataFrame, value: str, least: float, base: float, levels: int) -> DataFrame:
    """Rows per level: log of value / least to a base, half to even, clamped to the levels."""
    level = F.rint(F.log(F.col(value) / least) / math.log(base)).cast("long")
    return patches.groupBy(F.greatest(F.least(level, F.lit(levels - 1)), F.lit(0)).alias("level")).agg(F.count("*").alias("n"))


def splat_shape(splats: DataFrame, most: float) -> DataFrame:
    """Per scene: mean excess of longest over shortest scale beyond ``most``, and splats beyond it; a shortest scale of 0 makes an infinite ratio."""
    longest, shortest = F.greatest("s0", "s1", "s2"), F.least("s0", "s1", "s2")
    ratio = F.when(shortest == 0, float("inf")).otherwise(F.try_divide(longest, shortest))
    return splats.groupBy("scene_id").agg(F.avg(F.greatest(ratio, F.lit(most)) - most).alias("excess"), F.count_if(ratio > most).alias("outliers"))
