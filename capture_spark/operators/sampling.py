"""Seeded samples of pixels and rays: every draw is a function of the seed and its number, so reruns agree and nothing is collected."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_spark.shared import Scratch, numbered, settled

BITS = 30


def unit(seed: int, *of: Column | str | int) -> Column:
    """A number in [0, 1) from the seed and what it is drawn for."""
    parts = [x if isinstance(x, (Column, str)) else F.lit(x) for x in of]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << BITS)) / float(1 << BITS)


def _places(u: Column, n: Column | int) -> Column:
    return F.floor(u * n).cast("long")


def _images(scratch: Scratch, draws: DataFrame, images: DataFrame, u: Column) -> DataFrame:
    """Each draw with one of the images (scene_id, image_id, width, height), all alike, by its place in order."""
    placed = numbered(scratch, images.select("scene_id", "image_id", "width", "height"), ["scene_id", "image_id"], "at")
    n = placed.agg(F.count("*").alias("n_images"))
    return draws.join(F.broadcast(n)).withColumn("at", _places(u, F.col("n_images"))).join(placed, "at").drop("at", "n_images")


def _drawn(spark: SparkSession, n: int, images: DataFrame, seed: int, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``then`` makes of n draws, each with an image."""
    return settled(spark, "draws", lambda scratch: then(_images(scratch, spark.range(n).withColumnRenamed("id", "draw"), images, unit(seed, "draw", 0))))


def sample_pixels(spark: SparkSession, images: DataFrame, batch: int, seed: int) -> DataFrame:
    """``batch`` pixels (draw, scene_id, image_id, y, x), uniform over images and over each image's pixels."""
    return _drawn(spark, batch, images, seed, lambda d: d.select("draw", "scene_id", "image_id", _places(unit(seed, "draw", 1), F.col("height")).alias("y"), _places(unit(seed, "draw", 2), F.col("width")).alias("x")))


def sample_masked(pixels: DataFrame, batch: int, seed: int) -> DataFrame:
    """``batch`` of the pixels in the mask, without repeats: those of the smallest digests."""
    return pixels.filter("mask").orderBy(F.xxhash64(F.lit(seed), "scene_id", "image_id", "y", "x"), "scene_id", "image_id", "y", "x").limit(batch).select("scene_id", "image_id", "y", "x")


def sample_equirect(spark: SparkSession, images: DataFrame, batch: int, seed: int) -> DataFrame:
    """Pixels of panoramas, uniform on the sphere: rows by acos(1 - 2u) / pi."""
    row = F.acos(1 - 2 * unit(seed, "draw", 1)) / math.pi
    return _drawn(spark, batch, images, seed, lambda d: d.select("draw", "scene_id", "image_id", F.least(_places(row, F.col("height")), F.col("height") - 1).alias("y"), _places(unit(seed, "draw", 2), F.col("width")).alias("x")))


def sample_disc(spark: SparkSession, images: DataFrame, batch: int, radius: float, seed: int, tries: int = 64) -> DataFrame:
    """``batch`` pixels within a disc about each image's centre, uniform by area of what of the disc lies in the image.

    A place is drawn in the rectangle that disc and image share, and drawn again while it is
    outside the disc.  The disc fills over three quarters of that rectangle, so the
    tries end; the image's centre stands for a draw whose tries all miss (under 1 in 10**40).
    """

    def place(k: Column, side: str, n: int) -> Column:
        middle = F.floor(F.col(side) / 2).cast("double")
        low, high = F.greatest(middle - radius, F.lit(0.0)), F.least(middle + radius, F.col(side).cast("double"))
        return low + (high - low) * unit(seed, "draw", k, F.lit(n))

    def draw(d: DataFrame) -> DataFrame:
        mid = {side: F.floor(F.col(side) / 2).cast("double") for side in ("width", "height")}
        tried = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: F.struct(place(k, "height", 2).alias("y"), place(k, "width", 1).alias("x")))
        met = F.get(F.filter(tried, lambda p: (p["x"] - mid["width"]) ** 2 + (p["y"] - mid["height"]) ** 2 <= radius * radius), F.lit(0))
        at = lambda c, side: F.least(F.coalesce(F.col(f"p.{c}"), mid[side]).cast("long"), F.col(side).cast("long") - 1).alias(c)
        return d.withColumn("p", met).select("draw", "scene_id", "image_id", at("y", "height"), at("x", "width"))

    return _drawn(spark, batch, images, seed, draw)


def _squares(corners: DataFrame, side: int) -> DataFrame:
    """All pixels of the squares that begin at y0, x0."""
    d = corners.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return d.select("draw", "scene_id", "image_id", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))


def sample_patches(spark: SparkSession, images: DataFrame, batch: int, side: int, seed: int) -> DataFrame:
    """``batch`` // side**2 squares of pixels, each wholly inside its image: (draw, scene_id, image_id, y, x)."""
    large = images.filter((F.col("width") >= side) & (F.col("height") >= side))
    corner = {"y0": _places(unit(seed, "draw", 1), F.col("height") - side + 1), "x0": _places(unit(seed, "draw", 2), F.col("width") - side + 1)}
    return _drawn(spark, batch // side**2, large, seed, lambda d: _squares(d.withColumns(corner), side))


def sample_masked_patches(pixels: DataFrame, batch: int, side: int, seed: int) -> DataFrame:
    """``batch`` // side**2 squares that lie wholly in the mask of ``pixels`` (scene_id, image_id, y, x, mask), without repeats: those of the smallest digests.

    A square's pixels are counted by rows, then by columns, so the mask is worn away by as
    much as the square needs.  Fewer squares come out only if the masks hold fewer.
    """
    by_x = Window.partitionBy("scene_id", "image_id", "y").orderBy("x").rangeBetween(0, side - 1)
    by_y = Window.partitionBy("scene_id", "image_id", "x").orderBy("y").rangeBetween(0, side - 1)
    p = pixels.select("scene_id", "image_id", "y", "x", (F.count_if("mask").over(by_x) == side).alias("row_in"))
    p = p.select("scene_id", "image_id", F.col("y").alias("y0"), F.col("x").alias("x0"), (F.col("row_in") & (F.count_if("row_in").over(by_y) == side)).alias("whole")).filter("whole")
    digest = F.xxhash64(F.lit(seed), "scene_id", "image_id", "y0", "x0")
    chosen = p.withColumn("draw", digest).orderBy("draw", "scene_id", "image_id", "y0", "x0").limit(batch // side**2)
    return _squares(chosen, side)


def sample_pairs(spark: SparkSession, images: DataFrame, batch: int, radius: int, seed: int) -> DataFrame:
    """Pixels and a second one within ``radius`` rows and columns of each: two rows a draw, ``part`` 0 and 1, kept inside the image."""
    place = {"y": _places(unit(seed, "draw", 1), F.col("height")), "x": _places(unit(seed, "draw", 2), F.col("width"))}
    shift = lambda k: _places(unit(seed, "draw", k), 2 * radius + 1) - radius
    clip = lambda v, side: F.greatest(F.least(v, F.col(side) - 1), F.lit(0))
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("y").alias("y"), F.col("x").alias("x")), F.struct(F.lit(1).alias("part"), clip(F.col("y") + shift(3), "height").alias("y"), clip(F.col("x") + shift(4), "width").alias("x")))
    return _drawn(spark, batch // 2, images, seed, lambda d: d.withColumns(place).select("draw", "scene_id", "image_id", F.explode(both).alias("p")).select("draw", "scene_id", "image_id", "p.part", "p.y", "p.x"))


def level_counts(levels: int, batch: int, start: float = 1.0, end: float = 3.0) -> list[int]:
    """Draws per level by a straight ramp, rounded down; the last level takes the rest."""
    ramp = [start + (end - start) * k / max(levels - 1, 1) for k in range(levels)]
    counts = [int(x / sum(ramp) * batch) for x in ramp]
    counts[-1] += batch - sum(counts)
    return counts


def sample_by_level(patches: DataFrame, images: DataFrame, batch: int, levels: int, side: int, seed: int) -> DataFrame:
    """(level, draw, scene_id, image_id, y, x): draws of each level by ``level_counts`` from patches (scene_id, image_id, row, col, level) of that level.

    A pixel is drawn within the patch and kept inside its image; a level without
    patches draws from all images.
    """
    spark = patches.sparkSession
    wanted = spark.createDataFrame([(k, n) for k, n in enumerate(level_counts(levels, batch))], "level long, n long")
    put = lambda place, k, bound: F.least(F.col(place) * side + _places(unit(seed, "level", "draw", k), side), F.col(bound) - 1)

    def make(scratch: Scratch) -> DataFrame:
        placed = numbered(scratch, patches, ["level", "scene_id", "image_id", "row", "col"], "at")
        have = placed.groupBy("level").agg(F.count("*").alias("have"), F.min("at").alias("first"))
        draws = wanted.filter("n > 0").join(F.broadcast(have), "level", "left").withColumn("draw", F.explode(F.expr("sequence(0L, n - 1)")))
        d = draws.filter("have IS NOT NULL").withColumn("at", F.col("first") + _places(unit(seed, "level", "draw", 0), F.col("have"))).join(placed.drop("level"), "at")
        d = d.join(images.select("scene_id", "image_id", "width", "height"), ["scene_id", "image_id"])
        d = d.select("level", "draw", "scene_id", "image_id", put("row", 1, "height").alias("y"), put("col", 2, "width").alias("x"))
        rest = _images(scratch, draws.filter("have IS NULL").select("level", "draw"), images, unit(seed, "level", "draw", 3))
        rest = rest.select("level", "draw", "scene_id", "image_id", _places(unit(seed, "level", "draw", 4), F.col("height")).alias("y"), _places(unit(seed, "level", "draw", 5), F.col("width")).alias("x"))
        return d.unionByName(rest)

    return settled(spark, "draws", make)


def sample_rows(rays: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of a ray table, those of the smallest digests."""
    return rays.orderBy(F.xxhash64(F.lit(seed), "scene_id", "ray_id"), "scene_id", "ray_id").limit(n)


def slice_rows(rays: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) of each scene in order of id."""
    by = Window.partitionBy("scene_id").orderBy("ray_id")
    return rays.withColumn("position", F.row_number().over(by) - 1).filter((F.col("position") >= start) & (F.col("position") < end)).drop("position")
