"""Pixel tables: masks, pyramids, metrics, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_spark.operators.scenes import pose_of
from capture_spark.shared import Scratch, settled


def image_metrics(pixels: DataFrame) -> DataFrame:
    d = F.col("gt") - F.col("pred")
    m = pixels.groupBy("scene_id", "image_id").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("l1"), F.avg(F.when(F.col("mask"), d * d)).alias("masked_mse"))
    return m.withColumn("psnr", F.when(F.col("mse") == 0, float("inf")).otherwise(-10 * F.log10("mse")))


def depth_mse(pixels: DataFrame) -> DataFrame:
    d = F.col("depth_gt") - F.col("depth_pred")
    return pixels.filter("depth_gt > 0").groupBy("scene_id", "image_id").agg(F.avg(d * d).alias("depth_mse"), F.count("*").alias("valid"))


def align_depth(pixels: DataFrame) -> DataFrame:
    """Scale and shift of each image's depth, by least squares over valid pixels; (0, 0) if singular."""
    p, t = F.col("depth_pred"), F.col("depth_gt")
    s = pixels.filter("depth_gt > 0").groupBy("scene_id", "image_id").agg(F.sum(p * p).alias("a"), F.sum(p).alias("b"), F.count("*").cast("double").alias("n"), F.sum(p * t).alias("c"), F.sum(t).alias("d"))
    det = F.col("a") * F.col("n") - F.col("b") * F.col("b")
    s = s.withColumn("det", det)
    ok = F.abs("det") > 1e-9
    return s.select("scene_id", "image_id", F.when(ok, (F.col("n") * F.col("c") - F.col("b") * F.col("d")) / F.col("det")).otherwise(0.0).alias("scale"), F.when(ok, (F.col("a") * F.col("d") - F.col("b") * F.col("c")) / F.col("det")).otherwise(0.0).alias("shift"))


def ssi_mse(pixels: DataFrame) -> DataFrame:
    """Mean squared depth error after alignment."""
    e = F.col("scale") * F.col("depth_pred") + F.col("shift") - F.col("depth_gt")
    return pixels.filter("depth_gt > 0").join(align_depth(pixels), ["scene_id", "image_id"]).groupBy("scene_id", "image_id").agg(F.avg(e * e).alias("ssi_mse"))


def total_variation(cells: DataFrame, value: str = "gt") -> DataFrame:
    """Twice the mean squared row step plus that of the columns."""
    left = F.lag(value).over(Window.partitionBy("scene_id", "image_id", "y").orderBy("x"))
    above = F.lag(value).over(Window.partitionBy("scene_id", "image_id", "x").orderBy("y"))
    c = cells.select("scene_id", "image_id", ((F.col(value) - left) ** 2).alias("dx"), ((F.col(value) - above) ** 2).alias("dy"))
    return c.groupBy("scene_id", "image_id").agg((2 * (F.avg("dx") + F.avg("dy"))).alias("tv"))


def erode_mask(pixels: DataFrame, radius: int) -> DataFrame:
    """True where all pixels within ``radius`` are in the image and in the mask; first by rows, then by columns."""
    full = 2 * radius + 1
    by_x = Window.partitionBy("scene_id", "image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    by_y = Window.partitionBy("scene_id", "image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    p = pixels.withColumn("row_ok", (F.count_if("mask").over(by_x) == full))
    return p.select("scene_id", "image_id", "y", "x", (F.count_if("row_ok").over(by_y) == full).alias("mask"))


def dilate_mask(pixels: DataFrame, radius: int) -> DataFrame:
    """True where any pixel within ``radius`` is in the mask."""
    by_x = Window.partitionBy("scene_id", "image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    by_y = Window.partitionBy("scene_id", "image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    p = pixels.withColumn("row_any", F.max(F.col("mask")).over(by_x))
    return p.select("scene_id", "image_id", "y", "x", F.max("row_any").over(by_y).alias("mask"))


def crop_pixels(pixels: DataFrame, width: int, height: int, border: int = 0, factor: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """Pixels without a border and without fractions of the top, bottom, left and right; places count from the corner that is left."""
    top, bottom, left, right = (border + int(f * n) for f, n in zip(factor, (height, height, width, width), strict=True))
    inside = (F.col("x") >= left) & (F.col("x") < width - right) & (F.col("y") >= top) & (F.col("y") < height - bottom)
    return pixels.filter(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def image_pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """Means over squares of 2**level pixels for each level; crop first with ``crop_pixels``."""
    p = pixels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.pow(F.lit(2.0), F.col("level"))
    return p.groupBy("scene_id", "image_id", "level", F.floor(F.col("y") / side).alias("py"), F.floor(F.col("x") / side).alias("px")).agg(F.avg("gt").alias("value"))


def normalise_depth(pixels: DataFrame, near: float | None = None, far: float | None = None, accumulation: str | None = None) -> DataFrame:
    """Depth from 0 at ``near`` to 1 at ``far`` (by default the least and largest of the image), and its bin of 256.

    With a column of accumulations, what a ray doesn't meet is white: values are blended with 1.
    """
    by = Window.partitionBy("scene_id", "image_id")
    d = F.col("depth_pred")
    lo = F.min(d).over(by) if near is None else F.lit(float(near))
    hi = F.max(d).over(by) if far is None else F.lit(float(far))
    v = F.least(F.greatest((d - lo) / (hi - lo + 1e-10), F.lit(0.0)), F.lit(1.0))
    if accumulation:
        v = v * F.col(accumulation) + (1 - F.col(accumulation))
    return pixels.select("scene_id", "image_id", "y", "x", v.alias("value")).withColumn("bin", F.floor(F.col("value") * 255))


def semantic_mask(pixels: DataFrame, masked_classes: DataFrame) -> DataFrame:
    """Pixels in the mask whose class is not masked out."""
    return pixels.filter("mask").join(masked_classes, "class_id", "left_anti")


def make_mask(pixels: DataFrame, crop: tuple[float, float, float, float], part: float, width: int, height: int) -> DataFrame:
    """A crop rectangle and a centred disc of ``part`` of half the diagonal of an image of that size."""
    x0, y0, x1, y1 = crop
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    radius = part * (width * width + height * height) ** 0.5 / 2
    disc = (F.col("x") - (width - 1) / 2) ** 2 + (F.col("y") - (height - 1) / 2) ** 2 <= radius * radius
    return pixels.select("scene_id", "image_id", "y", "x", (inside & disc).alias("keep"))


def apply_mask_color(pixels: DataFrame, grey: float) -> DataFrame:
    return pixels.withColumn("gt", F.when(F.col("mask"), F.col("gt")).otherwise(grey))


def check_masks(frames: DataFrame) -> DataFrame:
    """Violations of a scene: some but not all frames with a mask or depth, and masks of another size than their image.

    ``frames`` has mask_path, depth_path, width, height, mask_width, mask_height.
    """
    some = lambda c: (F.count(c) > 0) & (F.count(c) < F.count("*"))
    sized = F.count_if(F.col("mask_path").isNotNull() & ((F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height"))))
    v = frames.groupBy("scene_id").agg(some("mask_path").alias("masks_differ"), some("depth_path").alias("depths_differ"), sized.alias("wrong_size"))
    return v.filter("masks_differ OR depths_differ OR wrong_size > 0")


def valid_depth(pixels: DataFrame, column: str = "depth_gt") -> DataFrame:
    return pixels.filter(F.col(column) > 0)


def gradient_error(pixels: DataFrame, scales: int = 4) -> DataFrame:
    """Per image: over every 2**s-th row and column, steps of the masked depth error between neighbours that are both valid, over valid pixels; summed over scales."""
    e = F.when(F.col("depth_gt") > 0, F.col("scale") * F.col("depth_pred") + F.col("shift") - F.col("depth_gt"))
    p = pixels.join(align_depth(pixels), ["scene_id", "image_id"]).select("scene_id", "image_id", "y", "x", e.alias("e"))
    p = p.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(scales - 1)))).withColumn("step", F.pow(F.lit(2.0), "s").cast("long"))
    p = p.filter((F.col("x") % F.col("step") == 0) & (F.col("y") % F.col("step") == 0))
    left = F.lag("e").over(Window.partitionBy("scene_id", "image_id", "s", "y").orderBy("x"))
    above = F.lag("e").over(Window.partitionBy("scene_id", "image_id", "s", "x").orderBy("y"))
    p = p.withColumns({"gx": F.abs(F.col("e") - left), "gy": F.abs(F.col("e") - above)})
    one = p.groupBy("scene_id", "image_id", "s").agg((F.coalesce(F.sum("gx"), F.lit(0.0)) + F.coalesce(F.sum("gy"), F.lit(0.0))).alias("g"), F.count("e").alias("n"))
    return one.groupBy("scene_id", "image_id").agg(F.sum(F.when(F.col("n") > 0, F.col("g") / F.col("n")).otherwise(0.0)).alias("image_loss"), F.sum("g").alias("g"), F.sum("n").alias("n"))


def batch_reduced(errors: DataFrame) -> DataFrame:
    """One row per scene: all images' steps over all valid pixels, and the mean of the images' losses."""
    return errors.groupBy("scene_id").agg((F.sum("g") / F.sum("n")).alias("batch_loss"), F.avg("image_loss").alias("image_loss"))


def normal_error(normals: DataFrame) -> DataFrame:
    """Per image: mean absolute difference and mean 1 - cosine of normals (ax, ay, az) and (bx, by, bz)."""
    l1 = sum((F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "yz"), F.abs(F.col("ax") - F.col("bx")))
    cosine = sum((F.col(f"a{c}") * F.col(f"b{c}") for c in "yz"), F.col("ax") * F.col("bx"))
    return normals.groupBy("scene_id", "image_id").agg(F.avg(l1).alias("l1"), F.avg(1 - cosine).alias("cosine"))


def normals_to_world(pixels: DataFrame, images: DataFrame, turn: list[list[float]] | None = None) -> DataFrame:
    """World normals of pixels whose normal is coded as 0..1 (n0, n1, n2): decoded, normalised, turned by the camera and then by ``turn``; a code of no direction stays 0."""
    n = [2 * F.col(f"n{k}") - 1 for k in range(3)]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    r, _ = pose_of(F.col("c2w"))
    p = pixels.join(images.select("scene_id", "image_id", "c2w"), ["scene_id", "image_id"])
    w = [F.when(size > 0, F.try_divide(sum((r[i][k] * n[k] for k in (1, 2)), r[i][0] * n[0]), size)).when(size == 0, 0.0) for i in range(3)]
    if turn:
        w = [sum((float(row[k]) * w[k] for k in (1, 2)), float(row[0]) * w[0]) for row in turn]
    return p.select("scene_id", "image_id", "y", "x", *[x.alias(f"w{k}") for k, x in enumerate(w)])


def ssim(pixels: DataFrame, window: int = 11) -> DataFrame:
    """Per image: mean structural similarity of ``gt`` and ``pred`` with a square mean window, zero beyond the edges.

    Sums over the window run by rows, then by columns, so no pixel meets others in a join.
    """
    r, full = window // 2, float(window * window)
    by_x = Window.partitionBy("scene_id", "image_id", "y").orderBy("x").rangeBetween(-r, r)
    by_y = Window.partitionBy("scene_id", "image_id", "x").orderBy("y").rangeBetween(-r, r)
    of = {"a": F.col("gt"), "b": F.col("pred"), "aa": F.col("gt") ** 2, "bb": F.col("pred") ** 2, "ab": F.col("gt") * F.col("pred")}
    p = pixels.select("scene_id", "image_id", "y", "x", *[F.sum(v).over(by_x).alias(k) for k, v in of.items()])
    p = p.select("scene_id", "image_id", *[(F.sum(k).over(by_y) / full).alias(k) for k in of])
    c1, c2 = 0.01**2, 0.03**2
    a, b = F.col("a"), F.col("b")
    value = (2 * a * b + c1) * (2 * (F.col("ab") - a * b) + c2) / ((a * a + b * b + c1) * (F.col("aa") - a * a + F.col("bb") - b * b + c2))
    return p.groupBy("scene_id", "image_id").agg(F.avg(value).alias("ssim"))


TERMS = ("r", "g", "b", "rr", "rg", "rb", "gg", "gb", "bb", "one")


def color_correct(pixels: DataFrame, rounds: int = 5, eps: float = 0.5 / 255) -> DataFrame:
    """Colours (r, g, b) fitted to the reference (ref_r, ref_g, ref_b) by least squares over their squares, products and a bias.

    Each round sums the normal equations per image over pixels unclipped at first, now
    and in the reference, solves one 10 x 10 system per image and channel, and clips
    to 0..1.  What is kept from round to round is 10 x 3 numbers an image, written to the
    shared folder; pixels are read as they were and taken through the rounds so far,
    so a plan has one pass over them and a join with a row an image.
    """
    import numpy as np
    import pandas as pd

    def equations(batches):
        """Sums of each image in a batch: for each channel the 10 x 10 products of terms, and those with the reference."""
        for b in batches:
            of = b.groupby(keys, sort=False).ngroup().to_numpy()
            by = np.argsort(of, kind="stable")[np.count_nonzero(of < 0) :]
            first = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]][: len(by)])
            now = {n: b[f"c_{n}"].to_numpy(float)[by] for n in "rgb"}
            x = np.stack([np.ones(len(by)) if t == "one" else now[t[0]] * now[t[1]] if len(t) == 2 else now[t] for t in TERMS], axis=1)
            refs = [b[f"ref_{n}"].to_numpy(float)[by] for n in "rgb"]
            known = np.isfinite(x).all(axis=1)  # a pixel without one of its colours is in no sum
            sound = [known & unclipped(b[n].to_numpy(float)[by]) & unclipped(now[n]) & unclipped(ref) for n, ref in zip("rgb", refs, strict=True)]
            sums = []
            for start, end in zip(first, [*first[1:], len(by)], strict=True):
                parts = []
                for ref, good in zip(refs, sound, strict=True):
                    own, right = x[start:end][good[start:end]], ref[start:end][good[start:end]]
                    parts += [(own.T @ own).ravel(), own.T @ right]
                sums.append(np.concatenate(parts))
            yield b[keys].iloc[by[first]].assign(sums=sums)

    def solve(batches):
        """The fit of each image from the sums of its batches, which come one after another."""
        image, own = None, []
        for b in batches:
            done = []
            for *of, sums in b[[*keys, "sums"]].itertuples(index=False, name=None):
                if of != image:
                    if own:
                        done.append((*image, fitted(own)))
                    image, own = of, []
                own = [*own, sums] if len(own) < 1000 else [np.sum([*own, sums], axis=0)]
            yield pd.DataFrame(done, columns=[*keys, "fit"])
        if own:
            yield pd.DataFrame([(*image, fitted(own))], columns=[*keys, "fit"])

    def fitted(own):
        sums = np.array(own).sum(axis=0).reshape(3, 110)
        return np.concatenate([np.linalg.lstsq(x[:100].reshape(10, 10), x[100:], rcond=None)[0] for x in sums])

    def unclipped(x):
        return (x >= eps) & (x <= 1 - eps)

    keys = ["scene_id", "image_id"]
    kinds = dict(pixels.dtypes)
    image = f"scene_id {kinds['scene_id']}, image_id {kinds['image_id']}"

    def terms(c: Column) -> list[Column]:
        return [F.lit(1.0) if t == "one" else c[t[0]] * c[t[1]] if len(t) == 2 else c[t] for t in TERMS]

    def step(c: Column, w: Column) -> Column:
        put = [sum((w[10 * k + i] * x for i, x in enumerate(terms(c))), F.lit(0.0)) for k in range(3)]
        return F.struct(*[F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)).alias(n) for n, x in zip("rgb", put, strict=True)])

    def now(p: DataFrame, fits: DataFrame | None) -> DataFrame:
        """Pixels with ``c``, the colour after the rounds so far."""
        own = F.struct(*[F.col(n).cast("double").alias(n) for n in "rgb"])
        return p.withColumn("c", own) if fits is None else p.join(fits, keys).withColumn("c", F.aggregate("fits", own, step)).drop("fits")

    def make(scratch: Scratch) -> DataFrame:
        fits = None
        for _ in range(rounds):
            p = now(pixels, fits).select(*keys, *"rgb", *[F.col("c")[n].alias(f"c_{n}") for n in "rgb"], *[f"ref_{n}" for n in "rgb"])
            sums = p.mapInPandas(equations, f"{image}, sums array<double>").repartition(*keys).sortWithinPartitions(*keys)
            fit = sums.mapInPandas(solve, f"{image}, fit array<double>")
            fits = scratch.written(fit.select(*keys, F.array("fit").alias("fits")) if fits is None else fits.join(fit, keys).select(*keys, F.concat("fits", F.array("fit")).alias("fits")))
        return now(pixels, fits).withColumns({n: F.col("c")[n] for n in "rgb"}).select(*pixels.columns)

    return settled(pixels.sparkSession, "corrected", make)


def depth_ranking(pixels: DataFrame) -> DataFrame:
    """Penalty of neighbouring pixel pairs whose predicted order differs from the true one."""
    p = pixels.withColumn("pair", F.floor(F.col("x") / 2))
    side = lambda c, k: F.max(F.when(F.col("x") % 2 == k, F.col(c)))
    p = p.groupBy("scene_id", "image_id", "y", "pair").agg((side("depth_gt", 0) - side("depth_gt", 1)).alias("t"), (side("depth_pred", 0) - side("depth_pred", 1)).alias("q"))
    return p.groupBy("scene_id", "image_id").agg(F.avg(F.when(F.signum("t") * F.signum("q") < 0, F.abs("q")).when(F.col("t").isNotNull(), 0.0)).alias("penalty"))
