"""Joins by time, by tolerance and by key with fallbacks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capture_spark.operators.scenes import compose, dot, pose, pose_of


def asof_forward(captures: DataFrame, poses: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """The first pose at or after each capture of its scene, else the scene's last pose.

    Captures and poses meet in buckets of time, so a long scene is many tasks.
    Each bucket's first pose is carried back over the (few) bucket rows; within a
    bucket a window runs backwards in time, each row looking only at what it has seen.
    """
    part = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / bucket_seconds)
    c = captures.select("scene_id", F.col("capture_ts").alias("at"), "capture_id", F.lit(None).cast("long").alias("pose_id"), F.lit(0).alias("is_pose"), part("capture_ts").alias("bucket"))
    p = poses.select("scene_id", F.col("pose_ts").alias("at"), F.lit(None).cast("long").alias("capture_id"), "pose_id", F.lit(1).alias("is_pose"), part("pose_ts").alias("bucket"))
    back = Window.partitionBy("scene_id", "bucket").orderBy(F.col("at").desc(), F.col("is_pose").desc(), F.col("pose_id").desc())
    inside = c.unionByName(p).withColumn("in_bucket", F.last("pose_id", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("is_pose = 0")
    firsts = p.groupBy("scene_id", "bucket").agg(F.min(F.struct("at", "pose_id"))["pose_id"].alias("first_pose"))
    marks = firsts.unionByName(c.select("scene_id", "bucket").distinct().withColumn("first_pose", F.lit(None).cast("long")))
    marks = marks.groupBy("scene_id", "bucket").agg(F.max("first_pose").alias("first_pose"))
    later = Window.partitionBy("scene_id").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("next_pose", F.last("first_pose", ignorenulls=True).over(later)).drop("first_pose")
    last = poses.groupBy("scene_id").agg(F.max(F.struct("pose_ts", "pose_id"))["pose_id"].alias("last_pose"))
    found = inside.join(marks, ["scene_id", "bucket"], "left").join(last, "scene_id", "left")
    return found.select("scene_id", "capture_id", F.coalesce("in_bucket", "next_pose", "last_pose").alias("pose_id"))


def band_join(captures: DataFrame, poses: DataFrame, seconds: float, digits: int = 3) -> DataFrame:
    """The pose of a capture: of those at its time to ``digits`` decimals, else of those less than ``seconds`` away, the last in file order (``pose_id``).

    Equi joins on the rounded time and on time buckets.
    """
    t = lambda c: F.col(c).cast("timestamp").cast("double")
    c = captures.withColumn("t", t("capture_ts"))
    p = poses.withColumn("pt", t("pose_ts"))
    exact = c.withColumn("key", F.round("t", digits)).join(p.select("scene_id", F.round("pt", digits).alias("key"), "pose_id"), ["scene_id", "key"])
    exact = exact.groupBy("scene_id", "capture_id").agg(F.max("pose_id").alias("exact_id"))
    near = c.withColumn("bucket", F.explode(F.expr(f"sequence(CAST(floor(t / {seconds}) AS BIGINT) - 1, CAST(floor(t / {seconds}) AS BIGINT) + 1)")))
    p = p.withColumn("bucket", F.floor(F.col("pt") / seconds).cast("long"))
    pairs = near.join(p.select("scene_id", "bucket", "pt", "pose_id"), ["scene_id", "bucket"]).filter(F.abs(F.col("t") - F.col("pt")) < seconds)
    near = pairs.groupBy("scene_id", "capture_id").agg(F.max("pose_id").alias("near_id"))
    return near.join(exact, ["scene_id", "capture_id"], "full").select("scene_id", "capture_id", F.coalesce("exact_id", "near_id").alias("pose_id"))


def fallback_lookup(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """The value at the key, else at key - 1, else at key + 1."""
    k = keys.select(F.col(key), F.posexplode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("rank", "shift")).withColumn("want", F.col(key) + F.col("shift"))
    t = table.select(F.col(key).alias("want"), value)
    return k.join(t, "want").groupBy(key).agg(F.min_by(value, "rank").alias(value))


def reconcile(metadata: DataFrame, images: DataFrame, name: str = "file_name") -> DataFrame:
    """Per scene: camera rows with an image of their base name, and how many of either side have none.

    A camera's name is tried as it stands and, if no image has it, up to its
    first dot.  Both tables have scene_id and ``name``; images' names lose their
    last extension.
    """
    i = images.select("scene_id", F.regexp_replace(name, r"\.[^.]*$", "").alias("base")).distinct()
    m = metadata.select("scene_id", F.col(name).alias("own"), F.element_at(F.split(name, r"\."), 1).alias("short"))
    m = m.join(i.withColumn("hit", F.lit(True)), (m["own"] == i["base"]) & (m["scene_id"] == i["scene_id"]), "left").select(m["scene_id"], "own", "short", "hit")
    m = m.withColumn("base", F.when(F.col("hit"), F.col("own")).otherwise(F.col("short"))).groupBy("scene_id", "base").agg(F.count("*").alias("cameras"))
    both = m.join(i.withColumn("image", F.lit(1)), ["scene_id", "base"], "full")
    n = F.coalesce("cameras", F.lit(0))
    return both.groupBy("scene_id").agg(F.sum(F.when(F.col("image").isNotNull(), n).otherwise(0)).alias("matched"), F.sum(F.when(F.col("image").isNull(), n).otherwise(0)).alias("no_image"), F.count_if(F.col("image").isNotNull() & F.col("cameras").isNull()).alias("no_metadata"))


def component_poses(cameras: DataFrame, components: DataFrame) -> DataFrame:
    """``c2w`` of each camera moved by its component's ``transform``; cameras of none, or of one without a transform, stay."""
    of = components.select("scene_id", "component_id", "transform")
    c = cameras.join(of, ["scene_id", "component_id"], "left")
    return c.withColumn("c2w", F.when(F.col("transform").isNull(), F.col("c2w")).otherwise(compose(F.col("transform"), F.col("c2w")))).drop("transform")


def renamed_images(images: DataFrame, names: DataFrame) -> DataFrame:
    """Images under the new names of a file map (scene_id, old_name, new_name); names that it lacks stay."""
    n = names.select("scene_id", F.col("old_name").alias("name"), "new_name")
    return images.join(n, ["scene_id", "name"], "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def moving_boxes(boxes: DataFrame, annotations: DataFrame, threshold: float) -> DataFrame:
    """The boxes of instances that move."""
    return boxes.join(dynamic_instances(annotations, threshold).filter("dynamic"), "instance_id", "left_semi")


NEAR = 0.01  # depth of the plane that boxes are cut at
PLACES = 1 << 19  # places on segments worked out at once
_IDS = ("scene_id", "image_id", "box_id")
_HALVES = np.array([(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]).T


def boxes_near_view(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs of a box and an image of its scene and time, but those where the ball around the box lies outside one of the five planes of the view.

    The planes are those of the image widened by a pixel, as ends may be rounded to
    whole ones, and the one at ``NEAR``.  They are worked out once an image, so a pair
    costs a few products.
    """
    numbers, lens = ("bx", "by", "bz", "sx", "sy", "sz", "yaw"), ("fx", "fy", "cx", "cy", "width", "height")
    reach = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2) / 2 + 1e-6 * (1 + F.abs("bx") + F.abs("by") + F.abs("bz"))
    b = boxes.select("scene_id", "sample_id", "box_id", *[F.col(c).cast("double").alias(c) for c in numbers]).na.drop(subset=list(numbers)).withColumn("_reach", reach)
    i = images.select("scene_id", "sample_id", "image_id", F.col("c2w").cast("array<double>").alias("c2w"), *[F.col(c).cast("double").alias(c) for c in lens])
    i = i.na.drop(subset=list(lens)).filter("size(c2w) = 12 AND NOT exists(c2w, x -> x IS NULL)")
    names = [f"_n{k}{c}" for k in range(5) for c in "xyzw"]

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("c2w").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 4)
            fx, fy, cx, cy, width, height = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in lens)
            right, up, ahead = m[:, :, 0], m[:, :, 1], -m[:, :, 2]
            normals = [fx * right + (cx + 1) * ahead, (width + 1 - cx) * ahead - fx * right, (cy + 1) * ahead - fy * up, (height + 1 - cy) * ahead + fy * up, ahead]
            made = []
            for k, n in enumerate(normals):
                size = np.maximum(np.sqrt((n * n).sum(axis=1)), 1e-300)
                made += [*(n / size[:, None]).T, (-(n * m[:, :, 3]).sum(axis=1) - (NEAR if k == 4 else 0.0)) / size]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], names=[*b.schema.names, *names])

    i = i.mapInArrow(planes, i.select("*", *[F.lit(0.0).alias(c) for c in names]).schema)
    inside = F.lit(True)
    for k in range(5):
        inside &= dot([F.col(f"_n{k}{c}") for c in "xyz"], [F.col("bx"), F.col("by"), F.col("bz")]) + F.col(f"_n{k}w") + F.col("_reach") > 0
    return b.join(i, ["scene_id", "sample_id"]).filter(inside).select(*_IDS, *numbers, "c2w", *lens)


def box_outlines(b: pa.RecordBatch, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, u, v) of a batch of ``boxes_near_view``: places in the image whose hull is the box's outline, for rows with as many corners in sight.

    What lies nearer than ``NEAR`` is cut off before it is projected, so no corner
    divides by 0; a box wholly behind that plane has no places.  They are those of
    the corners in sight, and of where the ways from these to the other corners meet the
    plane.  With ``whole``, they are whole pixels.  Terms are added in the order
    of the SQL twin, as places halfway between pixels are rounded.
    """
    col = {c: b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in b.schema.names if c not in (*_IDS, "c2w")}
    m = b.column(b.schema.get_field_index("c2w")).flatten().to_numpy(zero_copy_only=False).reshape(-1, 12).T[:, :, None]
    turns, at = np.unique(col["yaw"][:, 0], return_inverse=True)
    cos, sin = (np.array([f(x) for x in turns.tolist()])[at][:, None] for f in (math.cos, math.sin))
    i0, i1, i2 = _HALVES
    dx = col["bx"] + cos * col["sx"] * i0 - sin * col["sy"] * i1 - m[3]
    dy = col["by"] + sin * col["sx"] * i0 + cos * col["sy"] * i1 - m[7]
    dz = col["bz"] + col["sz"] * i2 - m[11]
    x, y, d = m[0] * dx + m[4] * dy + m[8] * dz, m[1] * dx + m[5] * dy + m[9] * dz, -(m[2] * dx + m[6] * dy + m[10] * dz)
    seen = d > NEAR
    n = seen.sum(axis=1)
    for k in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == k)
        by = np.argsort(~seen[rows], axis=1, kind="stable")
        p, q = zip(*[(c[:, :k, None], c[:, None, k:]) for c in (np.take_along_axis(c[rows], by, axis=1) for c in (x, y, d))], strict=True)
        cut = [(p[c] + (q[c] - p[c]) * (p[2] - NEAR) / (p[2] - q[2])).reshape(len(rows), -1) for c in (0, 1)]
        px, py = (np.concatenate([p[c][:, :, 0], cut[c]], axis=1) for c in (0, 1))
        depth = np.concatenate([p[2][:, :, 0], np.full(cut[0].shape, NEAR)], axis=1)
        u, v = col["fx"][rows] * px / depth + col["cx"][rows], col["cy"][rows] - col["fy"][rows] * py / depth
        yield rows, *((np.rint(u), np.rint(v)) if whole else (u, v))


def _made(b: pa.RecordBatch, rows: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows)) for c in _IDS], *[pa.array(x) for x in found.values()]], names=[*_IDS, *found])


def project_boxes(boxes: DataFrame, images: DataFrame, margin: float = 0.0) -> DataFrame:
    """(scene_id, image_id, box_id, x0, y0, x1, y1): the rectangle of each box in each image of its scene and time.

    ``boxes`` has (scene_id, sample_id, box_id), centre bx, by, bz, size sx, sy,
    sz and a yaw; ``images`` have sample_id, c2w (looking along -z) and
    intrinsics.  Of a box that reaches behind the camera, the part in sight counts (see
    ``box_outlines``); boxes outside the image altogether go.
    """
    pairs = boxes_near_view(boxes, images)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height")]
            for rows, *places in box_outlines(b):
                ends, keep = {}, np.ones(len(rows), bool)
                for c, place, side in zip("xy", places, sides, strict=True):
                    low, high, most = place.min(axis=1), place.max(axis=1), side[rows]
                    keep &= (high > 0) & (low < most)
                    ends |= {f"{c}0": np.clip(low - margin, 0, most), f"{c}1": np.clip(high + margin, 0, most)}
                yield _made(b, rows[keep], {c: ends[c][keep] for c in ("x0", "y0", "x1", "y1")})

    return pairs.mapInArrow(run, pairs.select(*_IDS, *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]).schema)


def _spans(u: np.ndarray, v: np.ndarray, width: np.ndarray, height: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the hull, y, x0, x1): pixels of a row in the hulls of places."""
    first, last = np.maximum(v.min(axis=1), 0), np.minimum(v.max(axis=1), height - 1)
    n = np.maximum(last - first + 1, 0).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    y_of = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    i, j = np.triu_indices(u.shape[1], 1)
    step = max(PLACES // len(i), 1)
    for start in range(0, len(of), step):
        k, y = of[start : start + step], y_of[start : start + step]
        ua, va, ub, vb = u[k][:, i], v[k][:, i], u[k][:, j], v[k][:, j]
        met = (np.minimum(va, vb) <= y[:, None]) & (np.maximum(va, vb) >= y[:, None])
        flat = va == vb
        at = ua + (y[:, None] - va) * (ub - ua) / np.where(flat, 1.0, vb - va)
        low = np.where(met, np.where(flat, np.minimum(ua, ub), at), np.inf).min(axis=1)
        high = np.where(met, np.where(flat, np.maximum(ua, ub), at), -np.inf).max(axis=1)
        x0, x1 = np.maximum(np.ceil(low - 1e-9), 0), np.minimum(np.floor(high + 1e-9), width[k] - 1)
        keep = x0 <= x1
        yield k[keep], *(x[keep].astype(np.int64) for x in (y, x0, x1))


def box_spans(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(scene_id, image_id, box_id, y, x0, x1): the pixels of each box's hull, a row of an image at a time, ends included.

    Corners are whole pixels; a pixel counts if its place lies in the hull of the box
    in sight or on it.  Along a row the hull reaches from the first to the last
    place where a way between two places of the outline meets it.  Images with ``ego_rows`` have
    that many rows at their bottom as a span of no box, where the own car is seen.
    """
    pairs = boxes_near_view(boxes, images)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, height = (b.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height"))
            for rows, u, v in box_outlines(b, whole=True):
                for k, y, x0, x1 in _spans(u, v, width[rows], height[rows]):
                    yield _made(b, rows[k], {"y": y, "x0": x0, "x1": x1})

    spans = pairs.mapInArrow(run, pairs.select(*_IDS, *[F.lit(0).cast("long").alias(c) for c in ("y", "x0", "x1")]).schema)
    if "ego_rows" not in images.columns:
        return spans
    strip = images.filter("ego_rows > 0").select("scene_id", "image_id", F.lit(None).cast(dict(spans.dtypes)["box_id"]).alias("box_id"), F.explode(F.sequence(F.greatest(F.col("height") - F.col("ego_rows"), F.lit(0)).cast("long"), F.col("height").cast("long") - 1)).alias("y"), F.lit(0).cast("long").alias("x0"), (F.col("width").cast("long") - 1).alias("x1"))
    return spans.unionByName(strip)


def span_masks(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """(scene_id, image_id, y, x, keep): false in any span of the image's row."""
    p = pixels.select("scene_id", "image_id", "y", "x")
    inside = p.join(spans, ["scene_id", "image_id", "y"]).filter(F.col("x").between(F.col("x0"), F.col("x1")))
    hit = inside.select("scene_id", "image_id", "y", "x").distinct().withColumn("hit", F.lit(True))
    return p.join(hit, ["scene_id", "image_id", "y", "x"], "left").select("scene_id", "image_id", "y", "x", F.col("hit").isNull().alias("keep"))


def box_masks(pixels: DataFrame, rectangles: DataFrame) -> DataFrame:
    """(scene_id, image_id, y, x, keep): false in any rectangle of the image."""
    inside = pixels.select("scene_id", "image_id", "y", "x").join(rectangles, ["scene_id", "image_id"]).filter((F.col("x") + 0.5).between(F.col("x0"), F.col("x1")) & (F.col("y") + 0.5).between(F.col("y0"), F.col("y1")))
    hit = inside.select("scene_id", "image_id", "y", "x").distinct().withColumn("hit", F.lit(True))
    return pixels.select("scene_id", "image_id", "y", "x").join(hit, ["scene_id", "image_id", "y", "x"], "left").select("scene_id", "image_id", "y", "x", F.col("hit").isNull().alias("keep"))


def dynamic_instances(annotations: DataFrame, threshold: float) -> DataFrame:
    """Instances with any speed that is not below the threshold; not-a-number counts as moving."""
    moving = F.isnan("speed") | ~(F.col("speed") < threshold)
    return annotations.groupBy("instance_id").agg(F.bool_or(moving).alias("dynamic"))


def sensor_star(sample_data: DataFrame, samples: DataFrame, sensors: DataFrame, egos: DataFrame) -> DataFrame:
    """Each record with its sample, sensor and ego rows; ``c2w`` is the ego's pose after the sensor's, with axes turned to the engine's.

    Sensors have ``sensor_pose``, egos ``ego_pose``, both 3x4 row by row.
    """
    s = sample_data.join(samples, ["scene_id", "sample_id"]).join(sensors, ["scene_id", "sensor_id"]).join(egos, ["scene_id", "ego_id"])
    s = s.withColumn("c2w", compose(F.col("ego_pose"), F.col("sensor_pose")))
    r, t = pose_of(F.col("c2w"))
    first = [[-1 * x for x in r[1]], [-1 * x for x in r[2]], r[0]]
    moved = [-t[1], -t[2], t[0]]
    turned = [[row[0], -row[1], -row[2]] for row in first]
    swapped, at = [turned[1], turned[0], [-x for x in turned[2]]], [moved[1], moved[0], -moved[2]]
    return s.withColumn("c2w", pose([swapped[2], swapped[1], [-x for x in swapped[0]]], [at[2], at[1], -at[0]]))
