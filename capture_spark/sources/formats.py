"""Readers of other capture formats: one row per frame (scene_id, file_path, intrinsics, c2w) or per record."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capture_spark.operators.joins import component_poses
from capture_spark.operators.scenes import invert, matmul, pose, pose_of, quaternion_rotation, to_camera_convention
from capture_spark.sources.captures import _scene
from capture_spark.sources.models import read_colmap_bin

ROW = "array<array<double>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _flat(matrix: Column) -> Column:
    """The first three rows of a matrix, row by row."""
    return F.flatten(F.slice(matrix, 1, 3))


def _nested(x):
    return [_nested(y) for y in x] if isinstance(x, (list, np.ndarray)) else x


def _posed(df: DataFrame, columns: tuple[str, ...], make) -> DataFrame:
    """Add ``c2w``: what ``make`` returns, batch by batch, for arrays of the columns: (n, 3, 4) camera to world poses."""
    schema = T.StructType([*df.schema.fields, T.StructField("c2w", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [np.array([_nested(x) for x in b[c]]) for c in columns]
            b["c2w"] = [[float(x) for x in p.ravel()] for p in make(*arrays)] if len(b) else []
            yield b

    return df.mapInPandas(run, schema)


def _turns(v: np.ndarray) -> np.ndarray:
    """Rotations of axes times their angles."""
    angle = np.sqrt((v * v).sum(1))[:, None, None]
    a = v / np.maximum(angle[:, :, 0], 1e-12)
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -a[:, 2], a[:, 1], -a[:, 0]
    k -= k.transpose(0, 2, 1)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def _inverse(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Camera to world of world to camera, camera axes turned from x right, y down to x right, y up."""
    back = r.transpose(0, 2, 1)
    return np.concatenate([back * [1, -1, -1], -(back @ t[:, :, None])], 2)


def _permuted(c2w: Column, rows: tuple[int, int, int], signs: tuple[int, int, int] = (1, 1, 1)) -> Column:
    r, t = pose_of(c2w)
    return pose([[s * x for x in r[i]] if s < 0 else r[i] for i, s in zip(rows, signs, strict=True)], [s * t[i] for i, s in zip(rows, signs, strict=True)])


def euler(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Rotation rows of degrees: roll about y, then pitch about x, then yaw about z."""
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (yaw, pitch, roll))
    o, z = F.lit(1.0), F.lit(0.0)
    return matmul(matmul([[cy, -sy, z], [sy, cy, z], [z, z, o]], [[o, z, z], [z, cp, -sp], [z, sp, cp]]), [[cr, z, sr], [z, o, z], [-sr, z, cr]])


def read_realitycapture(spark: SparkSession, path: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of a camera CSV whose image (scene_id, base_name, file_path, width, height) is there; and per scene how many cameras or images stand alone.

    Focal lengths are those of 35 mm film.
    """
    numbers = "f px py k1 k2 k3 k4 t1 t2 heading pitch roll x y alt".split()
    c = spark.read.option("header", True).csv(path).withColumn("scene_id", _scene())
    c = c.select("scene_id", F.regexp_replace("#name", r"\.[^.]*$", "").alias("base_name"), *[F.col(n).cast("double").alias(n) for n in numbers])
    both = c.join(images, ["scene_id", "base_name"], "full")
    summary = both.groupBy("scene_id").agg(F.count_if(F.col("file_path").isNotNull() & F.col("f").isNotNull()).alias("frames"), F.count_if(F.col("file_path").isNull()).alias("no_image"), F.count_if(F.col("f").isNull()).alias("no_camera"))
    side = F.greatest("width", "height")
    p = pose(euler(-F.col("heading"), F.col("pitch"), F.col("roll")), [F.col("x"), F.col("y"), F.col("alt")])
    frames = both.filter("file_path IS NOT NULL AND f IS NOT NULL").select(
        "scene_id", "file_path", F.col("width").alias("w"), F.col("height").alias("h"), (F.col("f") * side / 36.0).alias("fl_x"), (F.col("f") * side / 36.0).alias("fl_y"),
        (F.col("px") * side + F.col("width") / 2.0).alias("cx"), (F.col("py") * side + F.col("height") / 2.0).alias("cy"), "k1", "k2", "k3", "k4", F.col("t1").alias("p1"), F.col("t2").alias("p2"), p.alias("c2w"),
    )
    return frames, summary



def read_metashape(spark: SparkSession, path: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of a camera XML with an image (scene_id, base_name, file_path), and per scene the cameras left out for want of calibration or pose.

    Sensors, components and cameras are three tables; a camera's label is tried as it is, then up to its first dot.
    """

    def numbers(c: str) -> Column:
        return F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x.try_cast("double"))

    def table(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("scene_id", _scene())

    lens = ", ".join(f"{c}: string" for c in ("f", "cx", "cy", "k1", "k2", "k3", "k4", "p1", "p2"))
    s = table("sensor", f"_id string, _type string, resolution struct<_width: double, _height: double>, calibration array<struct<{lens}>>").filter("_id IS NOT NULL AND (size(calibration) > 0 OR _type = 'spherical')")
    cal = F.col("calibration")[0]
    get = lambda c: F.coalesce(cal[c].cast("double"), F.lit(0.0))
    w, h, sphere = F.col("resolution._width"), F.col("resolution._height"), cal.isNull()
    model = F.when(F.col("_type") == "frame", "OPENCV").when(F.col("_type") == "fisheye", "OPENCV_FISHEYE").when(F.col("_type") == "spherical", "EQUIRECTANGULAR")
    s = s.select("scene_id", F.col("_id").alias("sensor_id"), model.alias("camera_model"), w.alias("w"), h.alias("h"), F.when(sphere, w / 2).otherwise(get("f")).alias("fl_x"), F.when(sphere, h).otherwise(get("f")).alias("fl_y"), F.when(sphere, w / 2).otherwise(get("cx") + w / 2).alias("cx"), F.when(sphere, h / 2).otherwise(get("cy") + h / 2).alias("cy"), *[get(c).alias(c) for c in ("k1", "k2", "k3", "k4", "p1", "p2")])
    k = table("component", "_id string, transform struct<rotation: string, translation: string, scale: string>").filter("transform IS NOT NULL")
    k = k.select("scene_id", F.col("_id").alias("component_id"), numbers("transform.rotation").alias("r"), numbers("transform.translation").alias("t"), F.coalesce(F.col("transform.scale").cast("double"), F.lit(1.0)).alias("s"))
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    turn = [[F.coalesce(F.get("r", F.lit(3 * i + j)), F.lit(eye[3 * i + j])) for j in range(3)] for i in range(3)]
    k = k.select("scene_id", "component_id", pose(turn, [F.coalesce(F.get("t", F.lit(i)), F.lit(0.0)) / F.col("s") for i in range(3)]).alias("transform"))
    c = table("camera", "_id string, _label string, _sensor_id string, _component_id string, transform string").filter("_label IS NOT NULL")
    c = c.select("scene_id", F.col("_label").alias("label"), F.col("_sensor_id").alias("sensor_id"), F.col("_component_id").alias("component_id"), numbers("transform").alias("m"))
    known = images.select("scene_id", F.col("base_name").alias("label"), F.col("file_path").alias("exact"))
    short = images.select("scene_id", F.col("base_name").alias("short"), F.col("file_path").alias("cut"))
    c = c.withColumn("short", F.element_at(F.split("label", r"\."), 1)).join(known, ["scene_id", "label"], "left").join(short, ["scene_id", "short"], "left")
    c = c.withColumn("file_path", F.coalesce("exact", "cut")).filter("file_path IS NOT NULL").join(s, ["scene_id", "sensor_id"], "left")
    ready = F.col("w").isNotNull() & (F.coalesce(F.size("m"), F.lit(0)) == 16)
    summary = c.groupBy("scene_id").agg(F.count_if(ready).alias("frames"), F.count_if(~ready).alias("skipped"))
    f = component_poses(c.filter(ready).withColumn("c2w", F.slice("m", 1, 12)), k)
    f = f.withColumn("c2w", to_camera_convention(_permuted(F.col("c2w"), (2, 0, 1))))
    return f.select("scene_id", "file_path", "camera_model", "w", "h", "fl_x", "fl_y", "cx", "cy", "k1", "k2", "k3", "k4", "p1", "p2", "c2w"), summary


def read_odm(spark: SparkSession, root: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of ``cameras.json`` with ``reconstruction.json``, or ``shots.geojson`` where a scene has none; and per scene what stands alone.

    Files lie in ``root``/<scene>/; images have (scene_id, base_name, file_path).
    """
    numbers = "focal focal_x focal_y c_x c_y k1 k2 k3 p1 p2 width height".split()
    text = spark.read.text(f"{root}/*/cameras.json", wholetext=True).withColumn("scene_id", _scene())
    kind = f"map<string, struct<projection_type: string, {', '.join(f'{n}: double' for n in numbers)}>>"
    cams = text.select("scene_id", F.explode(F.from_json("value", kind)).alias("camera_id", "c"))
    side = F.greatest("c.width", "c.height")
    model = F.when(F.col("c.projection_type").isin("brown", "perspective"), "OPENCV").when(F.col("c.projection_type").isin("fisheye", "fisheye_opencv"), "OPENCV_FISHEYE").when(F.col("c.projection_type").isin("spherical", "equirectangular"), "EQUIRECTANGULAR")
    zero = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit(0.0))
    cams = cams.select("scene_id", model.alias("camera_model"), F.col("c.width").alias("w"), F.col("c.height").alias("h"), (F.coalesce("c.focal_x", "c.focal") * side).alias("fl_x"), (F.coalesce("c.focal_y", "c.focal") * side).alias("fl_y"), (zero("c_x") + (F.col("c.width") - 1) / 2).alias("cx"), (zero("c_y") + (F.col("c.height") - 1) / 2).alias("cy"), *[zero(c).alias(c) for c in ("k1", "k2", "k3", "p1", "p2")])
    shot = "struct<rotation: array<double>, translation: array<double>>"
    listing = spark.read.format("binaryFile").load(f"{root}/*/*json").select(F.element_at(F.split("path", "/"), -2).alias("scene_id"), F.element_at(F.split("path", "/"), -1).alias("file"))
    have = {r["file"] for r in listing.filter(F.col("file").isin("reconstruction.json", "shots.geojson")).select("file").distinct().collect()}  # two names at most
    parts = []
    if "reconstruction.json" in have:
        rec = spark.read.text(f"{root}/*/reconstruction.json", wholetext=True).withColumn("scene_id", _scene())
        rec = rec.select("scene_id", F.explode(F.from_json("value", f"array<struct<shots: map<string, {shot}>>>")[0]["shots"]).alias("name", "s"))
        parts.append(rec.select("scene_id", "name", F.col("s.rotation").alias("r"), F.col("s.translation").alias("t"), F.lit(False).alias("camera")))
    if "shots.geojson" in have:
        geo = _json(spark, f"{root}/*/shots.geojson", "features array<struct<properties: struct<filename: string, rotation: array<double>, translation: array<double>>>>").withColumn("scene_id", _scene())
        geo = geo.select("scene_id", F.explode("features.properties").alias("s")).select("scene_id", F.col("s.filename").alias("name"), F.col("s.rotation").alias("r"), F.col("s.translation").alias("t"), F.lit(True).alias("camera"))
        parts.append(geo.join(parts[0].select("scene_id").distinct(), "scene_id", "left_anti") if parts else geo)
    shots = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Shots of a reconstruction are world to camera; those of the fallback have the camera's place, a world to camera turn, and axes as they are.
    shots = shots.withColumn("base_name", F.regexp_replace("name", r"\.[^.]*$", ""))

    def placed(r: np.ndarray, t: np.ndarray, camera: np.ndarray) -> np.ndarray:
        turn = _turns(r)
        return np.where(camera[:, None, None], np.concatenate([turn.transpose(0, 2, 1), t[:, :, None]], 2), _inverse(turn, t))

    shots = _posed(shots, ("r", "t", "camera"), placed)
    both = shots.select("scene_id", "base_name", "c2w").join(images, ["scene_id", "base_name"], "full")
    summary = both.groupBy("scene_id").agg(F.count_if(F.col("c2w").isNotNull() & F.col("file_path").isNotNull()).alias("frames"), F.count_if(F.col("file_path").isNull()).alias("no_image"), F.count_if(F.col("c2w").isNull()).alias("no_shot"))
    return both.filter("c2w IS NOT NULL AND file_path IS NOT NULL").join(cams, "scene_id").drop("base_name"), summary


def read_record3d(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Frames of ``metadata.json``: poses (quaternion with the scalar last, then the place) at evenly spaced indices, ``most`` at most.

    Indices are those of even_subsample by truncation; the principal point is the image's centre.
    """
    m = _json(spark, path, "poses array<array<double>>, K array<double>, w double, h double").withColumn("scene_id", _scene())
    f = m.select("scene_id", "K", "w", "h", F.size("poses").alias("n"), F.posexplode("poses").alias("pos", "p"))
    k = F.least(F.col("n"), F.lit(most))
    step = (F.col("n") - 1).cast("double") / F.greatest(k - 1, F.lit(1))
    picks = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when((j == k - 1) & (k > 1), F.col("n") - 1).otherwise(F.rint(j * step).cast("int")))
    f = f.filter(F.array_contains(picks, F.col("pos")))
    q = [F.get("p", F.lit(i)) for i in (3, 0, 1, 2)]
    return f.select("scene_id", "pos", F.col("w"), F.col("h"), F.get("K", F.lit(0)).alias("fl_x"), F.get("K", F.lit(0)).alias("fl_y"), (F.col("w") / 2).alias("cx"), (F.col("h") / 2).alias("cy"), pose(quaternion_rotation(*q), [F.get("p", F.lit(i)) for i in (4, 5, 6)]).alias("c2w"))


def read_arkit(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(scene_id, line, ts, c2w) of ``lowres_wide.traj`` and (scene_id, frame_id, ts, w, h, fx, fy, cx, cy) of per-frame ``.pincam`` files.

    A trajectory line is a time, an axis times angle and a translation of world to camera.
    """
    words = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast("double"))
    t = spark.read.text(f"{root}/*/lowres_wide.traj", wholetext=True).withColumn("scene_id", _scene())
    t = t.select("scene_id", F.posexplode(F.split("value", "\n")).alias("line", "v")).filter("trim(v) <> ''").withColumn("f", words("v"))
    t = t.select("scene_id", "line", "f").withColumns({"r": F.slice("f", 2, 3), "t": F.slice("f", 5, 3)})
    t = _posed(t, ("r", "t"), lambda r, at: _inverse(_turns(r), at)[:, [1, 0, 2]] * np.array([1, 1, -1])[:, None])
    poses = t.select("scene_id", "line", F.round(F.get("f", F.lit(0)), 3).alias("ts"), "c2w")
    i = spark.read.text(f"{root}/*/*/*.pincam", wholetext=True).withColumn("scene_id", _scene(3)).withColumn("f", words("value"))
    name = F.regexp_extract("_metadata.file_path", r"([0-9.]+)\.pincam$", 1)
    i = i.select("scene_id", name.alias("frame_id"), name.cast("double").alias("ts"), *[F.get("f", F.lit(k)).alias(c) for k, c in enumerate(("w", "h", "fx", "fy", "cx", "cy"))])
    return poses, i


def read_aria(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(scene_id, ts_ns, c2w) of ``closed_loop_trajectory.csv`` and the points of ``semidense_points.csv.gz`` (inverse distance deviation kept)."""
    t = spark.read.option("header", True).csv(f"{root}/*/closed_loop_trajectory.csv").withColumn("scene_id", _scene())
    n = lambda c: F.col(c).cast("double")
    q = [n(f"q{c}_world_device") for c in "wxyz"]
    at = [n(f"t{c}_world_device") for c in "xyz"]
    poses = t.select("scene_id", (n("tracking_timestamp_us") * 1000).cast("long").alias("ts_ns"), pose(quaternion_rotation(*q), at).alias("c2w"))
    p = spark.read.option("header", True).csv(f"{root}/*/semidense_points.csv.gz").withColumn("scene_id", _scene())
    return poses, p.select("scene_id", F.col("uid").cast("long").alias("point3d_id"), *[n(f"p{c}_world").alias(c) for c in "xyz"], n("inv_dist_std").alias("inv_dist_std"))


def read_driving(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables sample, sample_data, sensors, egos and scenes of a relational driving set, ids and poses named as ``joins.sensor_star`` takes them."""
    three = [("rotation", "array<double>"), ("translation", "array<double>")]
    placed = ", ".join(f"{a} {b}" for a, b in three)
    q, t = [F.get("rotation", F.lit(i)) for i in range(4)], [F.get("translation", F.lit(i)) for i in range(3)]
    read = lambda name, schema: _json(spark, f"{root}/{name}.json", schema)
    scenes = read("scene", "token string, name string").select(F.col("token").alias("scene_id"), "name")
    samples = read("sample", "token string, scene_token string, timestamp long").select(F.col("scene_token").alias("scene_id"), F.col("token").alias("sample_id"), "timestamp")
    data = read("sample_data", "token string, sample_token string, calibrated_sensor_token string, ego_pose_token string, filename string, width long, height long")
    data = data.select(F.col("token").alias("sample_data_id"), F.col("sample_token").alias("sample_id"), F.col("calibrated_sensor_token").alias("sensor_id"), F.col("ego_pose_token").alias("ego_id"), "filename", "width", "height")
    data = data.join(samples.select("scene_id", "sample_id"), "sample_id")
    used = lambda c: data.select("scene_id", c).distinct()
    sensors = read("calibrated_sensor", f"token string, {placed}, camera_intrinsic {ROW}").select(F.col("token").alias("sensor_id"), pose(quaternion_rotation(*q), t).alias("sensor_pose"), F.col("camera_intrinsic").alias("intrinsic")).join(used("sensor_id"), "sensor_id")
    egos = read("ego_pose", f"token string, {placed}").select(F.col("token").alias("ego_id"), pose(quaternion_rotation(*q), t).alias("ego_pose")).join(used("ego_id"), "ego_id")
    return {"scenes": scenes, "samples": samples, "sample_data": data, "sensors": sensors, "egos": egos}


def read_dynamic(spark: SparkSession, root: str, bound: float = 1.0, factor: int = 1, split: str = "train") -> tuple[DataFrame, DataFrame]:
    """Frames of phone captures in motion and their scenes: scene.json, metadata.json, splits/<split>.json and camera/<frame>.json joined by frame.

    Centres are shifted and scaled so that the far plane fits a quarter of
    ``bound``; times are shares of the largest time id; near and far go with the scale.
    """
    scene = _json(spark, f"{root}/*/scene.json", "center array<double>, scale double, near double, far double").withColumn("scene_id", _scene())
    scene = scene.withColumn("factor", F.lit(bound) / 4 / (F.col("scale") * F.col("far")))
    scene = scene.select("scene_id", "center", (F.col("scale") * F.col("factor")).alias("s"), (F.col("near") * F.col("scale") * F.col("factor")).alias("near"), (F.col("far") * F.col("scale") * F.col("factor")).alias("far"))
    text = spark.read.text(f"{root}/*/metadata.json", wholetext=True).withColumn("scene_id", _scene())
    meta = text.select("scene_id", F.explode(F.from_json("value", "map<string, struct<warp_id: long, camera_id: long>>")).alias("frame", "m")).groupBy("scene_id").agg(F.max("m.warp_id").alias("last_time"))
    s = _json(spark, f"{root}/*/splits/{split}.json", "frame_names array<string>, time_ids array<long>").withColumn("scene_id", _scene(3))
    s = s.select("scene_id", F.posexplode(F.arrays_zip("frame_names", "time_ids")).alias("pos", "f")).select("scene_id", "pos", F.col("f.frame_names").alias("frame"), F.col("f.time_ids").alias("time_id"))
    c = _json(spark, f"{root}/*/camera/*.json", f"orientation {ROW}, position array<double>, focal_length double, pixel_aspect_ratio double, principal_point array<double>, image_size array<double>")
    c = c.withColumns({"scene_id": _scene(3), "frame": F.regexp_extract("_metadata.file_path", r"([^/]*)\.json$", 1)})
    f = s.join(c, ["scene_id", "frame"]).join(scene, "scene_id").join(meta, "scene_id", "left")

    def placed(orientation: np.ndarray, position: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
        p = np.concatenate([orientation.transpose(0, 2, 1) * [1, -1, -1], ((position - center) * scale[:, None])[:, :, None]], 2)
        return (p[:, [1, 0, 2]] * np.array([1, 1, -1])[:, None])[:, [1, 2, 0]]

    f = _posed(f, ("orientation", "position", "center", "s"), placed)
    d = float(factor)
    frames = f.select("scene_id", "pos", F.format_string(f"rgb/{factor}x/%s.png", "frame").alias("file_path"), (F.col("focal_length") / d).alias("fx"), (F.col("focal_length") * F.col("pixel_aspect_ratio") / d).alias("fy"), (F.col("principal_point")[0] / d).alias("cx"), (F.col("principal_point")[1] / d).alias("cy"), F.floor(F.col("image_size")[0] / d).alias("w"), F.floor(F.col("image_size")[1] / d).alias("h"), (F.col("time_id") / F.col("last_time")).alias("time"), "c2w")
    return frames, scene.withColumnRenamed("s", "scale")


def read_surface(spark: SparkSession, path: str, split: str = "train", every: int = 1) -> tuple[DataFrame, DataFrame]:
    """Frames of surface captures' ``meta_data.json`` (of other splits than train, every ``every``-th), and each scene's box."""
    m = _json(spark, path, f"height double, width double, scene_box struct<aabb: {ROW}>, frames array<struct<rgb_path: string, mono_depth_path: string, mono_normal_path: string, intrinsics: {ROW}, camtoworld: {ROW}>>").withColumn("scene_id", _scene())
    f = m.select("scene_id", F.col("height").alias("h"), F.col("width").alias("w"), F.posexplode("frames").alias("pos", "f"))
    f = f.filter((F.lit(split) == "train") | (F.col("pos") % every == 0))
    both = F.col("f.mono_depth_path").isNotNull() & F.col("f.mono_normal_path").isNotNull()
    k = lambda i, j: F.col("f.intrinsics")[i][j]
    frames = f.select("scene_id", "pos", F.col("f.rgb_path").alias("file_path"), F.when(both, F.col("f.mono_depth_path")).alias("depth_path"), F.when(both, F.col("f.mono_normal_path")).alias("normal_path"), k(0, 0).alias("fx"), k(1, 1).alias("fy"), k(0, 2).alias("cx"), k(1, 2).alias("cy"), "w", "h", to_camera_convention(_flat(F.col("f.camtoworld"))).alias("c2w"))
    return frames, m.select("scene_id", F.flatten("scene_box.aabb").alias("aabb"))


def read_sitcoms(spark: SparkSession, path: str, scene_scale: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Frames of ``cameras.json`` and each scene's box, turned a quarter about x, centred on the box, its longest side ``scene_scale`` long."""
    m = _json(spark, path, f"bbox {ROW}, frames array<struct<image_name: string, intrinsics: {ROW}, camtoworld: {ROW}>>").withColumn("scene_id", _scene())
    corner = lambda i: [F.col("bbox")[i][0], -F.col("bbox")[i][2], F.col("bbox")[i][1]]
    a, b = corner(0), corner(1)
    centre = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    longest = F.greatest(*[y - x for x, y in zip(a, b, strict=True)])
    m = m.withColumns({"centre": F.array(*centre), "scale": F.lit(scene_scale) / longest})
    box = m.select("scene_id", "scale", F.array(*[(x - c) * F.col("scale") for corner_ in (a, b) for x, c in zip(corner_, centre, strict=True)]).alias("aabb"))
    f = m.select("scene_id", "centre", "scale", F.posexplode("frames").alias("pos", "f"))
    r, t = pose_of(_permuted(_flat(F.col("f.camtoworld")), (0, 2, 1), (1, -1, 1)))
    c2w = pose(r, [(x - F.col("centre")[i]) * F.col("scale") for i, x in enumerate(t)])
    k = lambda i, j: F.col("f.intrinsics")[i][j]
    return f.select("scene_id", "pos", F.concat(F.lit("images/"), F.col("f.image_name")).alias("file_path"), k(0, 0).alias("fx"), k(1, 1).alias("fy"), k(0, 2).alias("cx"), k(1, 2).alias("cy"), c2w.alias("c2w")), box


def read_pose_dirs(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("pose", "intrinsics")) -> DataFrame:
    """(scene_id, position, <kind> ...): matrices of ``root``/<scene>/<kind>/*.txt side by side by their place in order of name.

    Numbers come row by row; scenes' images match by the same place.  Rows whose
    pose has an infinite entry go.
    """
    t = spark.read.text(f"{root}/*/*/*.txt", wholetext=True)
    t = t.select(_scene(3).alias("scene_id"), _scene(2).alias("kind"), F.col("_metadata.file_path").alias("path"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("m"))
    by = Window.partitionBy("scene_id", "kind").orderBy("path")
    t = t.filter(F.col("kind").isin(*kinds)).withColumn("position", F.row_number().over(by) - 1)
    wide = t.groupBy("scene_id", "position").agg(*[F.first(F.when(F.col("kind") == k, F.col("m")), ignorenulls=True).alias(k) for k in kinds])
    return wide.filter(~F.exists(kinds[0], lambda x: F.abs(x) == float("inf")))


def read_eyeful(spark: SparkSession, root: str, width: int, height: int, extension: str = "jpg") -> DataFrame:
    """Frames of ``cameras.json`` at a target size turned as each camera is, with the split that ``splits.json`` gives (null: none)."""
    camera = f"struct<cameraId: string, distortionModel: string, width: double, height: double, K: {ROW}, T: {ROW}, distortion: array<double>>"
    c = _json(spark, f"{root}/*/cameras.json", f"KRT array<{camera}>").withColumn("scene_id", _scene()).select("scene_id", F.explode("KRT").alias("c"))
    s = spark.read.text(f"{root}/*/splits.json", wholetext=True).withColumn("scene_id", _scene())
    s = s.select("scene_id", F.explode(F.from_json("value", "map<string, array<string>>")).alias("split", "ids")).select("scene_id", "split", F.explode("ids").alias("camera"))
    wide = F.col("c.width") > F.col("c.height")
    w, h = F.when(wide, max(width, height)).otherwise(min(width, height)), F.when(wide, min(width, height)).otherwise(max(width, height))
    sx, sy = w / F.col("c.width"), h / F.col("c.height")
    radial = F.col("c.distortionModel") == "RadialAndTangential"
    at = lambda plain, fish: F.when(radial, F.get("c.distortion", F.lit(plain)) if plain is not None else F.lit(0.0)).otherwise(F.get("c.distortion", F.lit(fish)) if fish is not None else F.lit(0.0))
    k = lambda i, j: F.col("c.K")[j][i]  # noqa: E731  stored column by column
    model = F.when(radial, "OPENCV").when(F.col("c.distortionModel") == "Fisheye", "OPENCV_FISHEYE")
    turn = [[F.col("c.T")[j][i] for j in range(4)] for i in range(3)]
    w2c = pose([x[:3] for x in turn], [x[3] for x in turn])
    lens = {"k1": at(0, 0), "k2": at(1, 1), "k3": at(4, 2), "k4": at(None, 3), "p1": at(2, None), "p2": at(3, None)}
    f = c.select("scene_id", F.col("c.cameraId").alias("camera"), model.alias("camera_model"), w.alias("w"), h.alias("h"), (k(0, 0) * sx).alias("fl_x"), (k(1, 1) * sy).alias("fl_y"), (k(0, 2) * sx).alias("cx"), (k(1, 2) * sy).alias("cy"), *[x.alias(n) for n, x in lens.items()], to_camera_convention(invert(w2c)).alias("c2w"))
    return f.join(s, ["scene_id", "camera"], "left").withColumn("file_path", F.concat("camera", F.lit(f".{extension}")))


def read_phototourism(spark: SparkSession, root: str) -> DataFrame:
    """Frames of binary models of photo collections: each camera with the image of the same id, pinhole cameras only."""
    cameras, images, _, _ = read_colmap_bin(spark, root)
    # Both tables are read from a short list of ranges, whose size Spark takes for theirs: without the hint it sends every camera to all executors by way of the driver.
    p = cameras.filter("model = 'PINHOLE'").withColumnRenamed("camera_id", "image_id").hint("merge").join(images.drop("camera_id"), ["scene_id", "image_id"])
    q, t = [F.get("qvec", F.lit(i)) for i in range(4)], [F.get("tvec", F.lit(i)) for i in range(3)]
    return p.select("scene_id", "image_id", F.col("name").alias("file_path"), *[F.get("params", F.lit(i)).alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))], "width", "height", to_camera_convention(invert(pose(quaternion_rotation(*q), t))).alias("c2w"))


def read_camera_path(spark: SparkSession, path: str) -> DataFrame:
    """Frames of camera path files: focal length from the field of view (panoramas: half the width, and the height), time where every camera has one."""
    m = _json(spark, path, "render_height double, render_width double, camera_type string, camera_path array<struct<camera_to_world: array<double>, fov: double, aspect: double, render_time: double>>").withColumn("scene_id", _scene())
    kind = F.lower(F.coalesce("camera_type", F.lit("perspective")))
    kind = F.when(kind.isin("fisheye", "equirectangular", "omnidirectional", "vr180"), kind).otherwise("perspective")
    timed = F.forall("camera_path", lambda c: c["render_time"].isNotNull())
    f = m.select("scene_id", kind.alias("camera_type"), F.col("render_width").alias("w"), F.col("render_height").alias("h"), timed.alias("timed"), F.posexplode("camera_path").alias("pos", "c"))
    focal, round_ = F.col("h") / 2 / F.tan(F.radians(F.col("c.fov")) / 2), F.col("camera_type").isin("equirectangular", "omnidirectional", "vr180")
    return f.select("scene_id", "pos", "camera_type", "w", "h", F.when(round_, F.col("w") / 2).otherwise(focal).alias("fx"), F.when(round_, F.col("h")).otherwise(focal).alias("fy"), (F.col("w") / 2).alias("cx"), (F.col("h") / 2).alias("cy"), F.when(F.col("timed"), F.col("c.render_time")).alias("time"), F.slice("c.camera_to_world", 1, 12).alias("c2w"))


def read_pixels(spark: SparkSession, path: str, alpha: tuple[float, float, float] | None = None) -> DataFrame:
    """(path, y, x, r, g, b, a) as shares of 255, of images that the built-in source decodes; grey counts thrice, ``alpha`` lies behind see-through pixels."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                p = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float) / 255
                rgb = np.repeat(p, 3, 2) if r.nChannels == 1 else p[:, :, 2::-1]  # stored blue first
                a = p[:, :, 3] if r.nChannels == 4 else np.ones(p.shape[:2])
                if alpha is not None:
                    rgb = rgb * a[:, :, None] + np.array(alpha) * (1 - a[:, :, None])
                rows = max(1, 200_000 // max(r.width, 1))
                for y in range(0, r.height, rows):
                    part, n = rgb[y : y + rows], len(rgb[y : y + rows])
                    yield pd.DataFrame({"path": r.origin, "y": np.repeat(np.arange(y, y + n), r.width), "x": np.tile(np.arange(r.width), n), **{c: part[:, :, k].ravel() for k, c in enumerate("rgb")}, "a": a[y : y + rows].ravel()})

    return i.mapInPandas(run, "path string, y long, x long, r double, g double, b double, a double")


def read_depth(spark: SparkSession, path: str, unit: float, width: int | None = None, height: int | None = None) -> DataFrame:
    """(path, y, x, depth) of ``.npy`` arrays times ``unit``; with a size, of the nearest value for each of its pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                d = np.load(io.BytesIO(data), allow_pickle=False).astype(float)
                d = d.reshape(d.shape[:2]) * unit
                if width and height:
                    d = d[(np.arange(height) * d.shape[0] // height)[:, None], (np.arange(width) * d.shape[1] // width)[None]]
                yield pd.DataFrame({"path": name, "y": np.repeat(np.arange(d.shape[0]), d.shape[1]), "x": np.tile(np.arange(d.shape[1]), d.shape[0]), "depth": d.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, y long, x long, depth double")
