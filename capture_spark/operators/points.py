"""Point clouds and structure-from-motion tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capture_spark.operators.scenes import pose_of
from capture_spark.shared import Scratch, settled

XYZ = ("x", "y", "z")


def within_aabb(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    keep = F.lit(True)
    for c, a, b in zip(XYZ, low, high, strict=True):
        keep = keep & (F.col(c) > a) & (F.col(c) < b)
    return points.filter(keep)


def box_rotation(roll: float, pitch: float, yaw: float) -> np.ndarray:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (cr, sr), (cp, sp), (cy, sy) = ((np.cos(a), np.sin(a)) for a in (roll, pitch, yaw))
    return np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]]) @ np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]]) @ np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]])


def within_obb(points: DataFrame, turn: tuple[float, float, float], centre: tuple, extent: tuple) -> DataFrame:
    """Points strictly inside a box turned by roll, pitch and yaw."""
    r = box_rotation(*turn)
    d = [F.col(c) - float(t) for c, t in zip(XYZ, centre, strict=True)]
    keep = F.lit(True)
    for k, e in enumerate(extent):
        keep = keep & (F.abs(sum((float(r[i, k]) * d[i] for i in (1, 2)), float(r[0, k]) * d[0])) < e / 2)
    return points.filter(keep)


def contract(points: DataFrame, order: str = "l2") -> DataFrame:
    """Unbounded space into the ball of radius 2."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in "yz"), F.col("x") * F.col("x"))) if order == "l2" else F.greatest(*[F.abs(c) for c in XYZ])
    k = F.when(n < 1, 1.0).otherwise((2 - 1 / n) / n)
    return points.withColumns({c: F.col(c) * k for c in XYZ})


def normalise_to_box(points: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Positions within the box of their scene, 0 to 1; along an axis in which the box is flat, the distance from it.

    ``boxes`` has (scene_id, min_x ... max_z), one row per scene; without it, a scene's box is that of its
    points.  Points outside a given box lie outside 0 to 1; those of scenes without a box go.
    """
    box = boxes.select("scene_id", *[F.col(f"{n}_{c}").alias(f"{to}_{c}") for c in XYZ for n, to in (("min", "lo"), ("max", "hi"))]) if boxes is not None else points.groupBy("scene_id").agg(*[F.min(c).alias(f"lo_{c}") for c in XYZ], *[F.max(c).alias(f"hi_{c}") for c in XYZ])
    return points.join(box, "scene_id").withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.col(c) - F.col(f"lo_{c}")) for c in XYZ}).select(*points.columns)


SH0 = 0.28209479177387814


def splat_colors(points: DataFrame) -> DataFrame:
    return points.withColumns({f"f_dc_{i}": (F.col(c) / 255.0 - 0.5) / SH0 for i, c in enumerate("rgb")}).withColumn("opacity", F.log(F.lit(0.1) / (1 - F.lit(0.1))))


def splat_rgb(splats: DataFrame) -> DataFrame:
    """Colours as bytes, held in 0 to 255, and ``alpha``, of splats: the way back from ``splat_colors`` for export."""
    byte = {c: F.greatest(F.least(F.floor((F.col(f"f_dc_{i}") * SH0 + 0.5) * 255 + 0.5), F.lit(255)), F.lit(0)).cast("long") for i, c in enumerate("rgb")}
    return splats.withColumns(byte | {"alpha": 1 / (1 + F.exp(-F.col("opacity")))})


def splat_counts(splats: DataFrame, columns: tuple[str, ...], least_opacity: float = -5.5373) -> DataFrame:
    """Per scene: splats, those that ``clean_splats`` keeps, those with an attribute that is not finite, and the faint ones of the rest."""
    bad = F.lit(False)
    for c in (*columns, "opacity"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    faint = ~bad & (F.col("opacity") < least_opacity)
    return splats.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(~bad & ~faint).alias("kept"), F.count_if(bad).alias("not_finite"), F.count_if(faint).alias("faint"))


def clean_splats(splats: DataFrame, columns: tuple[str, ...], least_opacity: float = -5.5373) -> DataFrame:
    """Splats with finite attributes and enough opacity."""
    keep = F.col("opacity") >= least_opacity
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return splats.filter(keep)


def spatial_hash(points: DataFrame, cell: float, bits: int, levels: int = 1, growth: float = 2.0) -> DataFrame:
    """(level, cell place, bucket) of each point: xor of the cell's coordinates times fixed odd numbers; cells shrink by ``growth`` a level."""
    p = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = F.lit(cell) / F.pow(F.lit(float(growth)), F.col("level"))
    p = p.withColumns({f"i{c}": F.floor(F.col(c) / size).cast("long") for c in XYZ})
    h = F.col("ix").bitwiseXOR(F.col("iy") * 2654435761).bitwiseXOR(F.col("iz") * 805459861)
    return p.withColumn("bucket", F.pmod(h, F.lit(1 << bits)))


def hash_collisions(hashed: DataFrame) -> DataFrame:
    """Per level: cells, buckets in use, and buckets with several cells."""
    cells = hashed.select("level", "bucket", "ix", "iy", "iz").distinct().groupBy("level", "bucket").agg(F.count("*").alias("n"))
    return cells.groupBy("level").agg(F.sum("n").alias("cells"), F.count("*").alias("buckets"), F.count_if(F.col("n") > 1).alias("shared"))


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    cell = [F.floor(F.col(c) / size).alias(f"i{c}") for c in XYZ]
    return points.groupBy("scene_id", *cell).agg(*[F.avg(c).alias(c) for c in (*XYZ, "r", "g", "b")], F.count("*").alias("n"))


def dedup_points(points: DataFrame) -> DataFrame:
    """One point for each position: the one of smallest id."""
    return points.groupBy("scene_id", *XYZ).agg(F.min("point3d_id").alias("point3d_id"))


CROWD = 2048  # places in a cell at most
FILL = 4  # places in a cell, as expected


def nearest(points: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """(scene_id, point3d_id, rank, other_id, distance): exact k nearest other points of a scene, ties by id.

    Points without finite coordinates take no part.  Points at one place meet
    others once: of a place only its k + 1 smallest ids can be anyone's nearest.
    Each scene's box is halved along its sides as often as its number of places needs for
    ``FILL`` of them in a cell (or to cells of ``cell``), and oftener where one holds over
    ``CROWD``, so a dense scene has small cells and leaves the others theirs.  A cell is
    one number, and those of the 27 cells around a place follow from it by addition.  What is found is exact within one cell's width; a place
    with fewer than k others that near asks again with cells four times as wide.
    """

    def make(scratch: Scratch) -> DataFrame:
        finite = F.lit(True)
        for c in XYZ:
            finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        ids = points.filter(finite).select("scene_id", "point3d_id", *[F.col(c).cast("double").alias(c) for c in XYZ])
        at_place = Window.partitionBy("scene_id", *XYZ).orderBy("point3d_id")
        few = ids.withColumn("place_rank", F.row_number().over(at_place)).filter(F.col("place_rank") <= k + 1)
        places = few.groupBy("scene_id", *XYZ).agg(F.array_sort(F.collect_list("point3d_id")).alias("others")).withColumn("place", F.monotonically_increasing_id())
        places = scratch.written(places)
        box = places.groupBy("scene_id").agg(F.count("*").alias("n"), *[F.min(c).alias(f"low_{c}") for c in XYZ], F.greatest(*[F.max(c) - F.min(c) for c in XYZ]).alias("side"))
        wanted = F.ceil(F.log2(F.greatest(F.col("n") / FILL, F.lit(1.0))) / 3) if cell is None else F.ceil(F.log2(F.greatest(F.col("side") / cell, F.lit(1.0))))
        scenes = scratch.written(box.withColumn("depth", F.when(F.col("side") > 0, F.least(wanted, F.lit(DEEPEST))).otherwise(0).cast("int")))
        while True:  # deeper where a cell is crowded; one row a scene comes out
            count = places.join(F.broadcast(scenes), "scene_id").groupBy("scene_id", _cell(0).alias("cell")).count()
            crowded = count.groupBy("scene_id").agg(F.max("count").alias("most")).filter(F.col("most") > CROWD)
            deeper = scratch.written(scenes.join(crowded, "scene_id", "left").withColumn("deeper", F.when((F.col("most") > CROWD) & (F.col("depth") < DEEPEST), F.least(F.col("depth") + F.ceil(F.log2(F.col("most") / CROWD) / 3).cast("int") + 1, F.lit(DEEPEST)))))
            if not deeper.filter("deeper IS NOT NULL").limit(1).count():
                break
            scenes = deeper.withColumn("depth", F.coalesce("deeper", "depth")).drop("most", "deeper")
        todo, done, up = places.select("scene_id", "place", *XYZ), None, 0
        while True:
            base = places.join(F.broadcast(scenes), "scene_id").select("scene_id", "others", *[F.col(c).alias(f"o{c}") for c in XYZ], _cell(up).alias("cell"))
            width = F.col("side") / F.pow(F.lit(2.0), F.greatest(F.col("depth") - up, F.lit(0)).cast("double"))
            near = todo.join(F.broadcast(scenes), "scene_id").select("scene_id", "place", *XYZ, width.alias("width"), (F.col("depth") <= up).alias("last"), _cell(up).alias("own"), F.explode(F.array(*[F.lit(s) for s in SHIFTS])).alias("shift"))
            near = near.select("scene_id", "place", *XYZ, "width", "last", (F.col("own") + F.col("shift")).alias("cell"))
            d = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("ox")) ** 2))
            pairs = near.join(base, ["scene_id", "cell"]).select("scene_id", "place", "width", "last", d.alias("distance"), F.explode("others").alias("other_id"))
            by = Window.partitionBy("scene_id", "place").orderBy("distance", "other_id")
            ranked = pairs.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
            found = ranked.groupBy("scene_id", "place").agg(F.array_sort(F.collect_list(F.struct("r", "distance", "other_id"))).alias("near"), F.max("width").alias("width"), F.bool_or("last").alias("last"))
            found = scratch.written(found.withColumn("sure", F.col("last") | ((F.size("near") > k) & (F.element_at("near", -1)["distance"] <= F.col("width")))).drop("width", "last"))
            sure = found.filter("sure").drop("sure")
            done = sure if done is None else done.unionByName(sure)
            if not found.filter("NOT sure").limit(1).count():
                break
            todo = todo.join(found.filter("NOT sure").select("scene_id", "place"), ["scene_id", "place"], "left_semi")
            up += 2
        # Every point of a place takes the place's list without itself.
        own = ids.join(places.select("scene_id", *XYZ, "place"), ["scene_id", *XYZ]).join(done, ["scene_id", "place"])
        out = own.select("scene_id", "point3d_id", F.posexplode(F.slice(F.filter("near", lambda x: x["other_id"] != F.col("point3d_id")), 1, k)).alias("at", "n"))
        return out.select("scene_id", "point3d_id", (F.col("at") + 1).alias("rank"), F.col("n.other_id").alias("other_id"), F.col("n.distance").alias("distance"))

    return settled(points.sparkSession, "nearest", make)


DEEPEST = 20  # halvings of a scene's box
SHIFTS = [a * 2**42 + b * 2**21 + c for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _cell(up: int) -> Column:
    """The number of a place's cell, ``up`` levels above its scene's deepest: 21 bits for each axis, so that the cells around it are ``SHIFTS`` away."""
    cells = F.pow(F.lit(2.0), F.greatest(F.col("depth") - up, F.lit(0)).cast("double"))
    side = F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)
    x, y, z = (F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / side * cells), cells.cast("long") - 1) for c in XYZ)
    return x * 2**42 + y * 2**21 + z


def remove_outliers(points: DataFrame, k: int, ratio: float, cell: float | None = None) -> DataFrame:
    """Points whose mean distance to k others is within the scene's mean and ``ratio`` deviations."""
    mean = nearest(points, k, cell).groupBy("scene_id", "point3d_id").agg(F.avg("distance").alias("d"))
    of = mean.groupBy("scene_id").agg((F.avg("d") + ratio * F.stddev_samp("d")).alias("most"))
    keep = mean.join(of, "scene_id").filter("d <= most")
    return points.join(keep.select("scene_id", "point3d_id"), ["scene_id", "point3d_id"], "left_semi")


def estimate_normals(points: DataFrame, k: int, cell: float | None = None, view: tuple[float, float, float] | None = None) -> DataFrame:
    """(scene_id, point3d_id, nx, ny, nz): the direction of least spread of each point and its k nearest; away from ``view`` if one is given.

    Six sums per point give the spread; its eigenvectors come from batches of 3 x 3 matrices.
    """
    near = nearest(points, k, cell).select("scene_id", "point3d_id", F.col("other_id").alias("of"))
    group = near.unionByName(points.select("scene_id", "point3d_id", F.col("point3d_id").alias("of")))
    at = points.select("scene_id", F.col("point3d_id").alias("of"), *XYZ)
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    spread = group.join(at, ["scene_id", "of"]).groupBy("scene_id", "point3d_id").agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs])

    def solve(batches):
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for p, q in pairs:
                i, j = XYZ.index(p), XYZ.index(q)
                m[:, i, j] = m[:, j, i] = b[f"{p}{q}"]
            n = np.linalg.eigh(m)[1][:, :, 0]
            lead = np.abs(n).argmax(1)
            n = n * np.sign(n[np.arange(len(n)), lead])[:, None]  # one sign of the two, always the same
            if view is not None:
                n = n * np.where(n @ np.array(view) > 0, -1, 1)[:, None]
            yield pd.DataFrame({"scene_id": b["scene_id"], "point3d_id": b["point3d_id"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})

    kinds = dict(points.dtypes)
    return spread.mapInPandas(solve, f"scene_id {kinds['scene_id']}, point3d_id {kinds['point3d_id']}, nx double, ny double, nz double")


def mesh_points(triangles: DataFrame, vertices: DataFrame, texels: DataFrame) -> DataFrame:
    """(scene_id, triangle_id, corner, x, y, z, r, g, b): the corners of each triangle, coloured by the texel at its uv.

    ``triangles`` has corners (array of vertex ids) and uv (array of (u, v)), v
    upwards; ``texels`` has the scene's texture by row and column.
    """
    size = texels.groupBy("scene_id").agg((F.max("col") + 1).alias("tw"), (F.max("row") + 1).alias("th"))
    c = triangles.select("scene_id", "triangle_id", F.posexplode(F.arrays_zip("corners", "uv")).alias("corner", "c"))
    c = c.select("scene_id", "triangle_id", "corner", F.col("c.corners").alias("vertex_id"), F.col("c.uv")[0].alias("u"), F.col("c.uv")[1].alias("v")).join(size, "scene_id")
    clamp = lambda x, n: F.greatest(F.least(F.floor(x), F.col(n) - 1), F.lit(0))
    c = c.withColumns({"col": clamp(F.col("u") * F.col("tw"), "tw"), "row": clamp((1 - F.col("v")) * F.col("th"), "th")})
    return c.join(vertices, ["scene_id", "vertex_id"]).join(texels, ["scene_id", "row", "col"]).select("scene_id", "triangle_id", "corner", *XYZ, "r", "g", "b")


def _seen(observations: DataFrame, points: DataFrame, images: DataFrame) -> DataFrame:
    """Observations with their point and image; ``depth`` along the camera's axis and ``distance`` to its centre, of poses that look along -z."""
    o = observations.join(points, ["scene_id", "point3d_id"]).join(images, ["scene_id", "image_id"])
    r, t = pose_of(F.col("c2w"))
    d = [F.col(c) - x for c, x in zip(XYZ, t, strict=True)]
    depth = -(r[0][2] * d[0] + r[1][2] * d[1] + r[2][2] * d[2])
    return o.withColumns({"depth": depth, "distance": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])})


def usable_observations(observations: DataFrame, points: DataFrame, images: DataFrame, depth: tuple[float, float] = (0.001, 10000.0), most_error: float = 2.5, least_track: int = 2) -> DataFrame:
    """Observations that can serve as depth: of well placed points, in the depth range, inside the image (``width``, ``height`` of ``images``)."""
    track = observations.groupBy("scene_id", "point3d_id").agg(F.count("*").alias("track"))
    good = points.filter(F.col("error") <= most_error).join(track.filter(F.col("track") >= least_track), ["scene_id", "point3d_id"])
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))
    return _seen(observations, good, images).filter(inside & F.col("depth").between(*depth))


def point_tracks(observations: DataFrame, k: int) -> DataFrame:
    """The first k observations of each point, in order of image and place, padded to k with -1; ``n`` of them are real."""
    by = Window.partitionBy("scene_id", "point3d_id").orderBy("image_id", "point2d_idx")
    top = observations.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
    t = top.groupBy("scene_id", "point3d_id").agg(F.array_sort(F.collect_list(F.struct("place", "image_id", "point2d_idx"))).alias("t"))
    pad = lambda c: F.concat(F.transform("t", lambda x: x[c].cast("long")), F.array_repeat(F.lit(-1).cast("long"), F.lit(k) - F.size("t")))
    return t.select("scene_id", "point3d_id", F.size("t").alias("n"), pad("image_id").alias("image_ids"), pad("point2d_idx").alias("places"))


def point_stats(observations: DataFrame, points: DataFrame) -> DataFrame:
    """(scene_id, point3d_id, track, error), and by ``scene_stats`` the scene's means."""
    track = observations.groupBy("scene_id", "point3d_id").agg(F.count("*").alias("track"))
    return points.select("scene_id", "point3d_id", "error").join(track, ["scene_id", "point3d_id"], "left").withColumn("track", F.coalesce("track", F.lit(0)))


def scene_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("scene_id").agg(F.count("*").alias("points"), F.avg("track").alias("mean_track"), F.avg("error").alias("mean_error"))


def sfm_depth(observations: DataFrame, points: DataFrame, images: DataFrame) -> DataFrame:
    """Depth from the camera in whole thousandths at each pixel; the last observation wins, depths wrap at 65536."""
    o = _seen(observations, points, images)
    pixel = o.groupBy("scene_id", "image_id", F.floor("u").alias("px"), F.floor("v").alias("py")).agg(F.max_by("depth", "point2d_idx").alias("depth"))
    return pixel.withColumn("depth", F.pmod((F.col("depth") * 1000).cast("long"), F.lit(65536)))


def point_frequency(observations: DataFrame, points: DataFrame, images: DataFrame, least: float = 1.0, base: float = 2.0, levels: int = 8) -> DataFrame:
    """(scene_id, point3d_id, f3d, level): median over views of image frequency times mean focal length over distance to the camera."""
    o = _seen(observations, points, images)
    f = o.groupBy("scene_id", "point3d_id").agg(F.median(F.col("f2d") * ((F.col("fx") + F.col("fy")) / 2) / (F.col("distance") + 1e-6)).alias("f3d"))
    level = F.rint(F.log(F.greatest(F.col("f3d"), F.lit(1e-12)) / least) / float(np.log(base))).cast("long")
    return f.withColumn("level", F.greatest(F.least(level, F.lit(levels - 1)), F.lit(0)))


def observed_frequency(observations: DataFrame, patches: DataFrame, images: DataFrame) -> DataFrame:
    """Observations with ``f2d`` of the map patch nearest to their place in the image; 0 where the image has no map.

    ``patches`` has (scene_id, image_id, row, col, f2d); corners of the map lie on corners of the image.
    """
    size = patches.groupBy("scene_id", "image_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    o = observations.drop("f2d").join(images.select("scene_id", "image_id", "width", "height"), ["scene_id", "image_id"]).join(size, ["scene_id", "image_id"], "left")
    at = lambda x, side, n: F.rint(F.col(x) / F.col(side) * (F.col(n) - 1)).cast("long")
    o = o.withColumns({"row": at("v", "height", "rows"), "col": at("u", "width", "cols")})
    return o.join(patches, ["scene_id", "image_id", "row", "col"], "left").withColumn("f2d", F.coalesce("f2d", F.lit(0.0))).drop("rows", "cols")


def backproject(rays: DataFrame, depth: DataFrame, least_opacity: float = 0.5) -> DataFrame:
    """Points o + d depth of the rays whose accumulated opacity is over ``least_opacity``; crop them with ``within_obb``."""
    seen = rays.join(depth.filter(F.col("accumulation") > least_opacity), ["scene_id", "ray_id"])
    return seen.select("scene_id", "ray_id", *[(F.col(f"o{c}") + F.col(f"d{c}") * F.col("depth")).alias(c) for c in XYZ])


def grid_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """(voxel_id, level): the larger of the stored and the new level."""
    n = new.groupBy("voxel_id").agg(F.max("level").alias("new_level"))
    return old.join(n, "voxel_id", "full").select("voxel_id", F.greatest("level", "new_level").alias("level"))


VOXELS, VIEWS, PIXELS = 16_384, 128, 1 << 18  # voxels, and views or pixels of views, that a group has, as expected


def voxel_hits(voxels: DataFrame, views: DataFrame, depth: DataFrame, truncation: float, cell: float | None = None, side: int = 8, behind: bool = True) -> DataFrame:
    """(scene_id, voxel_id, view_order, tsdf): signed distances of voxel centres to the depth that each view of their scene has there.

    A scene's voxels and views are dealt into parts, and each pair of parts is a group.
    In it, a view meets the voxels that are near enough to its camera for its largest depth.  Their
    centres are projected and looked up at the nearest pixel; nothing is hit outside the
    image, in the camera's plane, or over ``truncation`` behind the depth.
    Before that the distance counts 1 at most, back to the camera.  With ``behind``, places behind a camera are found
    in the pixel opposite, as a plain projection does.  Views look along -z.  Where
    ``depth`` has r, g and b, hits have them too.  Pairs of views and voxels grow with the product of both; ``cell`` and ``side`` no longer change anything.
    """
    colours = [c for c in "rgb" if c in depth.columns]
    r, t = pose_of(F.col("c2w"))
    pose = [F.array(*[x.cast("double") for x in [*t, *[r[i][k] for k in range(3) for i in range(3)], *[F.col(c) for c in ("fx", "fy", "cx", "cy")]]]).alias("pose")]
    pixel = F.struct(F.col("py").cast("long").alias("py"), F.col("px").cast("long").alias("px"), F.col("depth").cast("double").alias("depth"), *colours)
    depth = depth.filter("depth > 0 AND px IS NOT NULL AND py IS NOT NULL")
    maps = depth.groupBy("scene_id", "image_id").agg(F.array_sort(F.collect_list(pixel)).alias("map"))
    seen = views.select("scene_id", "image_id", *pose).join(maps, ["scene_id", "image_id"])
    v = voxels.select("scene_id", "voxel_id", *[F.col(c).cast("double").alias(c) for c in XYZ])
    n = v.groupBy("scene_id").agg(F.ceil(F.count("*") / VOXELS).alias("voxel_parts"))
    pixels = depth.groupBy("scene_id", "image_id").agg(F.count("*").alias("n"))
    n = n.join(pixels.groupBy("scene_id").agg(F.ceil(F.greatest(F.count("*") / VIEWS, F.sum("n") / PIXELS)).alias("view_parts")), "scene_id")
    keys = ["scene_id", "voxel_part", "view_part"]
    part = lambda c, of: F.pmod(F.xxhash64(c), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = v.join(F.broadcast(n), "scene_id").select("scene_id", part("voxel_id", "voxel_parts").alias("voxel_part"), every("view_parts").alias("view_part"), "voxel_id", *XYZ)
    right = seen.join(F.broadcast(n), "scene_id").select("scene_id", every("voxel_parts").alias("voxel_part"), part("image_id", "view_parts").alias("view_part"), "image_id", "pose", *[F.col("map")[c].alias(c) for c in ("py", "px", "depth", *colours)])
    out = left.select("scene_id", "voxel_id").join(right.select(F.col("image_id").alias("view_order"), F.lit(0.0).alias("tsdf"), *[F.get(c, F.lit(0)).alias(c) for c in colours]).limit(0)).schema

    def meet(own: pa.Table, views: pa.Table) -> pa.Table:
        own, views = own.combine_chunks(), views.combine_chunks()
        if not own.num_rows or not views.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        flat = {c: pc.list_flatten(views.column(c)).combine_chunks() for c in ("py", "px", "depth", *colours)}
        voxel, view, found, tsdf = _meet(np.column_stack([own.column(c).to_numpy() for c in XYZ]), np.array(views.column("pose").to_pylist(), float), pc.list_value_length(views.column("depth")).to_numpy(), *[flat[c].to_numpy(zero_copy_only=False) for c in ("py", "px", "depth")], truncation, behind)
        got = [own.column("scene_id").take(voxel), own.column("voxel_id").take(voxel), views.column("image_id").take(view), pa.array(tsdf), *[flat[c].take(found) for c in colours]]
        return pa.Table.from_arrays(got, schema=arrow)

    arrow = to_arrow_schema(out)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)


def _meet(places: np.ndarray, poses: np.ndarray, sizes: np.ndarray, py: np.ndarray, px: np.ndarray, depth: np.ndarray, truncation: float, behind: bool) -> tuple[pa.Array, ...]:
    """(voxel, view, pixel, tsdf) of the hits: rows of ``places``, of ``poses`` and of the pixels, which come view by view in order of row and column."""
    kept = np.flatnonzero(np.isfinite(places).all(axis=1))
    place = places[kept]
    norm = (place**2).sum(axis=1)
    view_of = np.repeat(np.arange(len(poses)), sizes)
    low = py.min(), px.min()
    rows, columns = int(py.max() - low[0]) + 1, int(px.max() - low[1]) + 1
    key = (view_of * rows + py - low[0]) * columns + px - low[1]
    start = np.cumsum(sizes) - sizes
    out = []
    for k, pose in enumerate(poses):
        if not np.isfinite(pose).all():
            continue
        t, r, (fx, fy, cx, cy) = pose[:3], pose[3:12], pose[12:]
        own = slice(start[k], start[k] + sizes[k])
        most = depth[own].max() + truncation
        if not most > 0:
            continue
        limit = (most * (1 + 1e-9)) ** 2
        rough = place @ (-2 * t) + norm  # squared distances but for the camera's own, to within rounding
        at = np.flatnonzero(rough <= limit - t @ t + 1e-9 * (limit + t @ t + norm.max(initial=0.0)))
        d = place[at] - t
        squared = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        close = squared <= limit
        at, far = at[close], np.sqrt(squared[close])
        dx, dy, dz = d[close].T
        x, y, z = (r[3 * i] * dx + r[3 * i + 1] * dy + r[3 * i + 2] * dz for i in range(3))
        y, z = -y, -z
        with np.errstate(divide="ignore", invalid="ignore"):
            row, column = np.floor(fy * y / z + cy) - low[0], np.floor(fx * x / z + cx) - low[1]
        inside = np.flatnonzero(((np.abs(z) if behind else z) > 1e-9) & (row >= 0) & (row < rows) & (column >= 0) & (column < columns))
        want = (k * rows + row[inside].astype(np.int64)) * columns + column[inside].astype(np.int64)
        begin, end = (np.searchsorted(key[own], want, side) + start[k] for side in ("left", "right"))
        times = end - begin  # a pixel given twice is hit twice
        hit = np.repeat(inside, times)
        pixel = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(len(hit))
        gap = depth[pixel] - far[hit]
        good = gap > -truncation
        out.append((kept[at[hit[good]]], np.full(good.sum(), k), pixel[good], np.maximum(np.minimum(gap[good] / truncation, 1.0), -1.0)))
    if not out:
        return (*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64()))
    return tuple(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))


def fuse_tsdf(hits: DataFrame) -> DataFrame:
    """Running halves in view order, v1 = x1 and vk = (v(k-1) + xk) / 2, in closed form; of r, g and b too, where hits have them."""
    by = Window.partitionBy("scene_id", "voxel_id")
    h = hits.withColumns({"k": F.row_number().over(by.orderBy("view_order")), "n": F.count("*").over(by)})
    power = F.when(F.col("k") == 1, F.col("n") - 1).otherwise(F.col("n") - F.col("k") + 1)
    share = F.pow(F.lit(2.0), -power.cast("double"))
    colours = [F.sum(F.col(c) * share).alias(c) for c in "rgb" if c in hits.columns]
    return h.groupBy("scene_id", "voxel_id").agg(F.sum(F.col("tsdf") * share).alias("value"), F.count("*").alias("n"), *colours)


def fused_grid(voxels: DataFrame, hits: DataFrame) -> DataFrame:
    """Every voxel with its fused value and colour; one that no view hits has value -1, colour 0 and ``n`` 0."""
    fused = fuse_tsdf(hits)
    default = {"value": -1.0, "n": 0, **{c: 0.0 for c in "rgb" if c in fused.columns}}
    return voxels.select("scene_id", "voxel_id", *XYZ).join(fused, ["scene_id", "voxel_id"], "left").fillna(default)


def refine_box(voxels: DataFrame, margin: float) -> DataFrame:
    """Per scene: the box around the cells where the distance changes its sign to a cell beside them, widened by ``margin``.

    ``voxels`` has (scene_id, ix, iy, iz, value) and the cell's centre x, y, z.
    """
    change = F.lit(False)
    for c, (p, q) in {"ix": ("iy", "iz"), "iy": ("ix", "iz"), "iz": ("ix", "iy")}.items():
        by = Window.partitionBy("scene_id", p, q).orderBy(c)
        for step in (F.lag, F.lead):
            change = change | F.coalesce((F.abs(step(c).over(by) - F.col(c)) == 1) & (F.signum(step("value").over(by)) * F.signum("value") < 0), F.lit(False))
    surface = voxels.withColumn("surface", change).filter("surface")
    return surface.groupBy("scene_id").agg(*[(F.min(c) - margin).alias(f"min_{c}") for c in XYZ], *[(F.max(c) + margin).alias(f"max_{c}") for c in XYZ])


def pca_rgb(features: DataFrame, column: str, out: int = 3, bound: float = 2.0) -> DataFrame:
    """Vectors on their first principal axes, scaled to 0..1 within robust bounds; all-zero vectors become 0.

    Means and outer products are summed in Spark (their size is that of one
    vector); the robust range is that of the values within ``bound`` median
    deviations of the median.
    """
    f = features.withColumn("_v", F.col(column).cast("array<double>")).withColumn("_zero", F.forall("_v", lambda x: x == 0))
    width = f.agg(F.max(F.size("_v"))).first()[0] or 0
    v = [F.col("_v")[i] for i in range(width)]
    used = f.filter("NOT _zero")

    def sums(batches):
        whole = np.zeros((width + 1, width + 1))
        for b in batches:
            x = np.column_stack([np.ones(len(b)), np.array(b["_v"].tolist(), float).reshape(len(b), width)])
            whole += x.T @ x
        yield pd.DataFrame({"at": np.arange(whole.size), "value": whole.ravel()})

    whole = np.zeros((width + 1) ** 2)
    for r in used.select("_v").mapInPandas(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # the size of one outer product
        whole[r["at"]] = r["value"]
    whole = whole.reshape(width + 1, width + 1) / max(whole[0], 1.0)
    mean, cov = whole[0, 1:], whole[1:, 1:] - np.outer(whole[0, 1:], whole[0, 1:])
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :out] if width else np.zeros((0, out))
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1) if width else axes
    names = [f"pc{k}" for k in range(axes.shape[1])]
    dot = lambda k: sum((float(axes[i, k]) * (v[i] - float(mean[i])) for i in range(1, width)), float(axes[0, k]) * (v[0] - float(mean[0])))
    p = f.withColumns({n: dot(k) for k, n in enumerate(names)})
    some = p.filter("NOT _zero")
    mid = some.agg(*[F.median(n) for n in names]).first()
    spread = some.agg(*[F.median(F.abs(F.col(n) - float(m))) for n, m in zip(names, mid, strict=True)]).first() if some.limit(1).count() else None
    if spread is None:
        return f.select(*features.columns, *[F.lit(0.0).alias(n) for n in names])
    inside = [F.when(F.abs(F.col(n) - float(m)) <= bound * float(s), F.col(n)) for n, m, s in zip(names, mid, spread, strict=True)]
    ends = some.agg(*[F.min(x) for x in inside], *[F.max(x) for x in inside]).first()
    scaled = {n: F.when(F.col("_zero"), 0.0).otherwise(F.greatest(F.least((F.col(n) - float(lo)) / max(float(hi - lo), 1e-12), F.lit(1.0)), F.lit(0.0))) for n, lo, hi in zip(names, ends[: len(names)], ends[len(names) :], strict=True)}
    return p.withColumns(scaled).select(*features.columns, *names)
