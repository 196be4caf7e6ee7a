"""Rays and their samples: intersections, weights, composites, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _along(end: int) -> WindowSpec:
    """The samples of a ray from the first to this one (0) or the one before (-1); one order serves all."""
    return Window.partitionBy("scene_id", "ray_id").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, end)


def ray_weights(samples: DataFrame) -> DataFrame:
    """Add ``alpha``, ``transmittance`` and ``weight``; not-a-number weights count 0."""
    s = samples.withColumn("mass", F.col("delta") * F.col("density"))
    s = s.withColumns({"alpha": 1 - F.exp(-F.col("mass")), "transmittance": F.exp(-F.coalesce(F.sum("mass").over(_along(-1)), F.lit(0.0)))})
    return s.withColumn("weight", F.nanvl(F.col("alpha") * F.col("transmittance"), F.lit(0.0)))


def alpha_weights(samples: DataFrame) -> DataFrame:
    """Weights from alphas: the product of what samples before let through, as a sum of logarithms."""
    s = samples.withColumn("alpha", 1 - F.exp(-F.col("delta") * F.col("density")))
    through = F.exp(F.coalesce(F.sum(F.log(1 - F.col("alpha") + 1e-7)).over(_along(-1)), F.lit(0.0)))
    return s.withColumn("transmittance", through).withColumn("weight", F.col("alpha") * F.col("transmittance"))


def composite(samples: DataFrame, background: float | str | None = None) -> DataFrame:
    """Colour and accumulation of each ray, over nothing, a grey level, or the ``last`` sample."""
    w = ray_weights(samples)
    sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in "rgb"]
    out = w.groupBy("scene_id", "ray_id").agg(*sums, F.sum("weight").alias("accumulation"), *[F.max_by(c, "sample_idx").alias(f"last_{c}") for c in "rgb"])
    if background is not None:
        out = out.withColumns({c: F.col(c) + (F.col(f"last_{c}") if background == "last" else F.lit(float(background))) * (1 - F.col("accumulation")) for c in "rgb"})
    return out.select("scene_id", "ray_id", "r", "g", "b", "accumulation")


def _middle() -> Column:
    return F.col("t_start") + F.col("delta") / 2


def depth_median(samples: DataFrame) -> DataFrame:
    """The first middle where half the weight lies behind, else the last."""
    w = ray_weights(samples).withColumns({"sum": F.sum("weight").over(_along(0)), "mid": _middle()})
    half = F.min(F.when(F.col("sum") >= 0.5, F.struct("sample_idx", "mid")))
    return w.groupBy("scene_id", "ray_id").agg(F.coalesce(half["mid"], F.max(F.struct("sample_idx", "mid"))["mid"]).alias("depth"))


def depth_expected(samples: DataFrame) -> DataFrame:
    """The mean depth, kept within the table's smallest and largest middle."""
    w = ray_weights(samples).withColumn("mid", _middle())
    ends = samples.agg(F.min(_middle()).alias("lo"), F.max(_middle()).alias("hi"))
    mean = w.groupBy("scene_id", "ray_id").agg((F.sum(F.col("weight") * F.col("mid")) / (F.sum("weight") + 1e-10)).alias("depth"))
    return mean.crossJoin(ends).select("scene_id", "ray_id", F.greatest(F.least("depth", "hi"), "lo").alias("depth"))


def composite_channel(samples: DataFrame, channel: str) -> DataFrame:
    return ray_weights(samples).groupBy("scene_id", "ray_id").agg(F.sum(F.col("weight") * F.col(channel)).alias("value"))


def ray_distortion(samples: DataFrame) -> DataFrame:
    """Sum over pairs of w w |m - m| plus a third of w w delta, by prefix sums."""
    w = ray_weights(samples).withColumn("mid", _middle())
    w = w.withColumns({"sw": F.coalesce(F.sum("weight").over(_along(-1)), F.lit(0.0)), "swm": F.coalesce(F.sum(F.col("weight") * F.col("mid")).over(_along(-1)), F.lit(0.0))})
    pairs = F.sum(2 * F.col("weight") * (F.col("mid") * F.col("sw") - F.col("swm")))
    return w.groupBy("scene_id", "ray_id").agg((pairs + F.sum(F.col("weight") * F.col("weight") * F.col("delta")) / 3).alias("distortion"))


def depth_supervision(samples: DataFrame, depth: DataFrame, sigma: float, kind: str = "gaussian") -> DataFrame:
    """Loss of each ray with a depth: minus log weight against a Gaussian, or line of sight.

    ``sight`` adds to the squared error of the expected depth the squared
    distance of weights from a normal of a third of sigma within sigma of the
    depth, and squared weights before that.
    """
    w = ray_weights(samples).withColumn("mid", _middle()).join(depth.filter("depth > 0"), ["scene_id", "ray_id"])
    gap = F.col("mid") - F.col("depth")
    by = w.groupBy("scene_id", "ray_id")
    if kind == "gaussian":
        return by.agg(F.sum(-F.log(F.col("weight") + 1e-7) * F.exp(-(gap**2) / (2 * sigma)) * F.col("delta")).alias("loss"))
    s = sigma / 3
    normal = F.exp(-(gap**2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    sight = F.when(F.abs(gap) <= sigma, (F.col("weight") - normal) ** 2).when(gap < -sigma, F.col("weight") ** 2).otherwise(0.0)
    expected = F.sum(F.col("weight") * F.col("mid")) / (F.sum("weight") + 1e-10)
    return by.agg(((F.first("depth") - expected) ** 2 + F.sum(sight)).alias("loss"))


def normal_penalties(samples: DataFrame, rays: DataFrame) -> DataFrame:
    """Per ray: weights of normals (nx, ny, nz) that face away from the camera, squared, and weights times 1 - cosine to the predicted (px, py, pz)."""
    w = ray_weights(samples).join(rays.select("scene_id", "ray_id", "dx", "dy", "dz"), ["scene_id", "ray_id"])
    facing = -(F.col("nx") * F.col("dx") + F.col("ny") * F.col("dy") + F.col("nz") * F.col("dz"))
    alike = F.col("nx") * F.col("px") + F.col("ny") * F.col("py") + F.col("nz") * F.col("pz")
    return w.groupBy("scene_id", "ray_id").agg(F.sum(F.col("weight") * F.least(facing, F.lit(0.0)) ** 2).alias("orientation"), F.sum(F.col("weight") * (1 - alike)).alias("predicted"))


def interlevel(samples: DataFrame, proposals: DataFrame) -> DataFrame:
    """Per ray: by how much final weights exceed the proposal weights that overlap them, squared over the weight."""
    bound = interval_envelope(samples.select("scene_id", "ray_id", "sample_idx", "t_start", "delta"), proposals)
    w = samples.join(bound, ["scene_id", "ray_id", "sample_idx"], "left")
    over = F.greatest(F.col("weight") - F.coalesce("bound", F.lit(0.0)), F.lit(0.0))
    return w.groupBy("scene_id", "ray_id").agg(F.sum(over * over / (F.col("weight") + 1e-7)).alias("loss"))


def interval_envelope(targets: DataFrame, envelopes: DataFrame) -> DataFrame:
    """For each target interval that meets one, the weight of the envelope intervals that overlap it.

    That is the weight of those that start before its end, less the weight of those
    that end by its start.  Starts and ends of both tables stand in one order along
    a ray, and running sums are read off at the targets' ends: work grows with a ray's
    intervals, not with their pairs.  Intervals without length take no part.
    """
    some = lambda df: df.select("scene_id", "ray_id", *[c for c in ("sample_idx", "weight") if c in df.columns], "t_start", (F.col("t_start") + F.col("delta")).alias("t_end")).filter("t_end > t_start")
    none = F.lit(None)
    e = some(envelopes.drop("sample_idx")).select("scene_id", "ray_id", none.cast(dict(targets.dtypes)["sample_idx"]).alias("sample_idx"), "weight", F.explode(F.array(F.struct(F.col("t_start").alias("at"), F.lit(3).alias("kind")), F.struct(F.col("t_end").alias("at"), F.lit(1).alias("kind")))).alias("m"))
    t = some(targets.drop("weight")).select("scene_id", "ray_id", "sample_idx", none.cast("double").alias("weight"), F.explode(F.array(F.struct(F.col("t_start").alias("at"), F.lit(2).alias("kind")), F.struct(F.col("t_end").alias("at"), F.lit(0).alias("kind")))).alias("m"))
    # At one place: targets' ends, envelopes' ends, targets' starts, envelopes' starts.
    marks = e.unionByName(t).select("scene_id", "ray_id", "sample_idx", "weight", "m.at", "m.kind")
    so_far = Window.partitionBy("scene_id", "ray_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)).over(so_far), F.lit(0))
    sums = marks.withColumns({"started": of(3, F.col("weight")), "ended": of(1, F.col("weight")), "n_started": of(3, F.lit(1)), "n_ended": of(1, F.lit(1))}).filter("kind IN (0, 2)")
    by = sums.groupBy("scene_id", "ray_id", "sample_idx")
    last = F.col("kind") == 0
    out = by.agg(F.sum(F.when(last, F.col("started")).otherwise(-F.col("ended"))).alias("bound"), F.sum(F.when(last, F.col("n_started")).otherwise(-F.col("n_ended"))).alias("n"))
    return out.filter("n > 0").drop("n")


def sample_rays(rays: DataFrame, n: int, near: float, far: float, spacing: str = "uniform", seed: int | None = None) -> DataFrame:
    """n intervals per ray, even in the spacing's scale; with a seed, inner edges move at random within half a step to either side."""
    there, back = {
        "uniform": (lambda x: x, lambda x: x),
        "inverse": (lambda x: 1 / x, lambda x: 1 / x),
        "sqrt": (F.sqrt, lambda x: x * x),
        "log": (F.log, F.exp),
        "piecewise": (lambda x: F.when(x < 1, x / 2).otherwise(1 - 1 / (2 * x)), lambda x: F.when(x < 0.5, 2 * x).otherwise(1 / (2 - 2 * x))),
    }[spacing]
    lo, hi = there(F.lit(float(near))), there(F.lit(float(far)))

    def at(k: Column) -> Column:
        if seed is not None:
            shift = F.pmod(F.xxhash64(F.lit(seed), "scene_id", "ray_id", k), F.lit(1 << 30)) / float(1 << 30) - 0.5
            k = F.when((k > 0) & (k < n), k + shift).otherwise(k.cast("double"))
        return back(lo + (hi - lo) * (k / float(n)))

    s = rays.select("scene_id", "ray_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_idx"))
    return s.select("scene_id", "ray_id", "sample_idx", at(F.col("sample_idx")).alias("t_start"), at(F.col("sample_idx") + 1).alias("t_end"))


def resample_pdf(samples: DataFrame, n: int, padding: float = 0.01) -> DataFrame:
    """n places per ray spread as its weights, by linear steps of the summed weights.

    Each quantile meets the interval that holds it by a range condition within the ray.
    """
    w = ray_weights(samples).withColumn("p", F.col("weight") + padding)
    w = w.withColumn("whole", F.sum("p").over(Window.partitionBy("scene_id", "ray_id")))
    w = w.withColumns({"lo": F.coalesce(F.sum("p").over(_along(-1)), F.lit(0.0)) / F.col("whole"), "hi": F.sum("p").over(_along(0)) / F.col("whole")})
    first = F.greatest(F.ceil(F.col("lo") * n - 0.5).cast("int") - 1, F.lit(0))  # only the quantiles near the interval, then those in it
    last = F.least(F.floor(F.col("hi") * n - 0.5).cast("int") + 1, F.lit(n - 1))
    w = w.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("u", (F.col("k") + 0.5) / n)
    w = w.filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return w.select("scene_id", "ray_id", "k", (F.col("t_start") + F.col("delta") * (F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("t"))


def merged_bins(samples: DataFrame, n: int, padding: float = 0.01) -> DataFrame:
    """(scene_id, ray_id, sample_idx, t_start, t_end): a ray's intervals cut again at n places spread as its weights."""
    ends = samples.groupBy("scene_id", "ray_id").agg(F.max(F.col("t_start") + F.col("delta")).alias("t"))
    edges = samples.select("scene_id", "ray_id", F.col("t_start").alias("t")).unionByName(ends).unionByName(resample_pdf(samples, n, padding).drop("k"))
    by = Window.partitionBy("scene_id", "ray_id").orderBy("t")
    cut = edges.select("scene_id", "ray_id", (F.row_number().over(by) - 1).alias("sample_idx"), F.col("t").alias("t_start"), F.lead("t").over(by).alias("t_end"))
    return cut.filter("t_end IS NOT NULL")


def ray_box(rays: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Near and far of the slab test, clamped to 0 and 1e10; 1e10 for both where the box is missed."""
    inverse = lambda d: F.when(F.col(d) == 0, F.lit(1e30)).otherwise(1 / F.when(F.col(d) == 0, F.lit(1.0)).otherwise(F.col(d)))
    a = [(F.lit(l) - F.col(f"o{c}")) * inverse(f"d{c}") for c, l in zip("xyz", low, strict=True)]
    b = [(F.lit(h) - F.col(f"o{c}")) * inverse(f"d{c}") for c, h in zip("xyz", high, strict=True)]
    near = F.greatest(*[F.least(x, y) for x, y in zip(a, b, strict=True)], F.lit(0.0))
    far = F.least(*[F.greatest(x, y) for x, y in zip(a, b, strict=True)], F.lit(1e10))
    return rays.select("scene_id", "ray_id", near.alias("n"), far.alias("f")).select("scene_id", "ray_id", F.when(F.col("f") >= F.col("n"), F.col("n")).otherwise(1e10).alias("near"), F.when(F.col("f") >= F.col("n"), F.col("f")).otherwise(1e10).alias("far"))


def ray_sphere(rays: DataFrame, radius: float) -> DataFrame:
    """Near and far on a sphere about the origin for the rays that meet it."""
    b = F.col("ox") * F.col("dx") + F.col("oy") * F.col("dy") + F.col("oz") * F.col("dz")
    c = F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2 - radius * radius
    r = rays.select("scene_id", "ray_id", b.alias("b"), (b * b - c).alias("q")).filter("q >= 0")
    return r.select("scene_id", "ray_id", F.greatest(-F.col("b") - F.sqrt("q"), F.lit(0.0)).alias("near"), F.greatest(-F.col("b") + F.sqrt("q"), F.lit(0.0)).alias("far"))


def constant_bounds(rays: DataFrame, near: float, far: float) -> DataFrame:
    """The same near and far for every ray."""
    return rays.select("scene_id", "ray_id", F.lit(float(near)).alias("near"), F.lit(float(far)).alias("far"))


def pixels_to_rays(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """Unit directions in the camera frame of perspective pixels, each with the camera of its scene and ``camera_id``."""
    p = pixels.join(cameras, ["scene_id", "camera_id"])
    dx, dy = (F.col("x") + 0.5 - F.col("cx")) / F.col("fx"), -(F.col("y") + 0.5 - F.col("cy")) / F.col("fy")
    n = F.sqrt(dx * dx + dy * dy + 1)
    return p.select("scene_id", "image_id", "y", "x", (dx / n).alias("dx"), (dy / n).alias("dy"), (-1 / n).alias("dz"), n.alias("norm"))


def depth_to_distance(pixels: DataFrame, cameras: DataFrame, depth: str = "depth_gt") -> DataFrame:
    """Pixels with ``distance``, the length along their ray of a depth along the optical axis."""
    return pixels.join(pixels_to_rays(pixels, cameras), ["scene_id", "image_id", "y", "x"]).withColumn("distance", F.col(depth) * F.col("norm"))


def distance_to_depth(pixels: DataFrame, cameras: DataFrame, distance: str = "distance") -> DataFrame:
    """Pixels with ``depth``: a length along a ray times the cosine of the ray's angle to the optical axis."""
    return pixels.join(pixels_to_rays(pixels, cameras).select("scene_id", "image_id", "y", "x", F.col("dz").alias("_dz")), ["scene_id", "image_id", "y", "x"]).withColumn("depth", -F.col(distance) * F.col("_dz")).drop("_dz")
