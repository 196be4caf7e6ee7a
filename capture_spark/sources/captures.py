"""Readers and writers of capture formats: one row per frame, camera, image or point."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capture_spark.sources.files import write_files
from capture_spark.sources.models import read_colmap_bin

NUMBERS = ("fl_x", "fl_y", "cx", "cy", "w", "h", "k1", "k2", "k3", "k4", "p1", "p2")
_FIELDS = [T.StructField(c, T.DoubleType()) for c in NUMBERS]
_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
_FRAME = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("transform_matrix", _MATRIX), T.StructField("time", T.DoubleType()), *_FIELDS])


def _scene(back: int = 2):
    """The folder that a file lies in (or one further up) as its scene."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -back)


_NAMES = T.ArrayType(T.StringType())
TRANSFORMS = T.StructType(
    [
        *_FIELDS,
        T.StructField("camera_angle_x", T.DoubleType()),
        T.StructField("camera_model", T.StringType()),
        T.StructField("frames", T.ArrayType(_FRAME)),
        *[T.StructField(f"{s}_filenames", _NAMES) for s in ("train", "val", "test")],
    ]
)


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """Frames of ``transforms.json`` files in order of name; the top level's intrinsics win over a frame's."""
    meta = spark.read.schema(TRANSFORMS).option("multiLine", True).json(path).withColumn("scene_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    by_name = F.array_sort("frames", lambda a, b: F.when(a["file_path"] < b["file_path"], -1).when(a["file_path"] > b["file_path"], 1).otherwise(0))
    f = meta.select("scene_id", "camera_model", *[F.col(c).alias(f"top_{c}") for c in NUMBERS], F.posexplode(by_name).alias("pos", "frame"))
    c2w = F.flatten(F.slice("frame.transform_matrix", 1, 3))
    return f.select("scene_id", "pos", "frame.file_path", F.coalesce("camera_model", F.lit("OPENCV")).alias("camera_model"), *[F.coalesce(F.col(f"top_{c}"), F.col(f"frame.{c}")).alias(c) for c in NUMBERS], c2w.alias("c2w"))


def read_synthetic(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Frames of ``transforms_{split}.json`` files whose focal length comes from ``camera_angle_x``."""
    meta = spark.read.schema(TRANSFORMS).option("multiLine", True).json(path)
    where = F.col("_metadata.file_path")
    meta = meta.withColumns({"scene_id": F.element_at(F.split(where, "/"), -2), "split": F.regexp_extract(where, r"transforms_(\w+)\.json$", 1)})
    f = meta.select("scene_id", "split", (0.5 * width / F.tan(0.5 * F.col("camera_angle_x"))).alias("focal"), F.posexplode("frames").alias("pos", "frame"))
    path_ = F.concat(F.regexp_replace("frame.file_path", r"^\./", ""), F.lit(".png"))
    return f.select("scene_id", "split", "pos", path_.alias("file_path"), "focal", F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), F.col("frame.time").alias("time"), F.flatten(F.slice("frame.transform_matrix", 1, 3)).alias("c2w"))


def _records(spark: SparkSession, path: str, per: int) -> DataFrame:
    """(scene_id, line, value): the lines of text files without comments, numbered from 0; of ``per`` lines to a record, the others are in ``rest``.

    Files are read as streams of lines by the task that has them, so no file is
    one value; a blank line within a record counts.
    """
    files = spark.read.format("binaryFile").load(path).select("path").repartition(max(1, spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for name in b["path"]:
                where, at = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))
                out, n, held = [], 0, []
                with where.open_input_stream(at) as raw:
                    for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8"):
                        line = line.rstrip("\r\n")
                        if line.startswith("#") or (not held and not line.strip()):
                            continue
                        held.append(line)
                        if len(held) == per:
                            out.append((at.split("/")[-2], n, held[0], held[1] if per > 1 else None))
                            n, held = n + 1, []
                            if len(out) == 10_000:
                                yield pd.DataFrame(out, columns=["scene_id", "line", "value", "rest"])
                                out = []
                if held:
                    out.append((at.split("/")[-2], n, held[0], ""))
                yield pd.DataFrame(out, columns=["scene_id", "line", "value", "rest"])

    return files.mapInPandas(read, "scene_id string, line long, value string, rest string")


def read_colmap_text(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cameras, images, points3d and observations of text models under ``root``/*/."""
    word = lambda i, kind="double": F.get("f", F.lit(i - 1)).cast(kind)
    split = lambda c: F.split(F.trim(c), r"\s+")
    c = _records(spark, f"{root}/*/cameras.txt", 1).withColumn("f", split("value"))
    rest = F.transform(F.expr("slice(f, 5, greatest(size(f) - 4, 0))"), lambda x: x.cast("double"))
    cameras = c.select("scene_id", word(1, "long").alias("camera_id"), word(2, "string").alias("model"), word(3, "long").alias("width"), word(4, "long").alias("height"), rest.alias("params"))
    i = _records(spark, f"{root}/*/images.txt", 2).withColumn("f", split("value"))
    images = i.select("scene_id", word(1, "long").alias("image_id"), F.array(*[word(k) for k in range(2, 6)]).alias("qvec"), F.array(*[word(k) for k in range(6, 9)]).alias("tvec"), word(9, "long").alias("camera_id"), word(10, "string").alias("name"), "rest")
    o = images.filter("trim(rest) <> ''").withColumn("f", split("rest"))
    o = o.select("scene_id", "image_id", "f", F.explode(F.expr("sequence(0, cast(size(f) / 3 as int) - 1)")).alias("point2d_idx"))
    at = lambda k, kind: F.element_at("f", F.col("point2d_idx") * 3 + k).cast(kind)
    observations = o.select("scene_id", "image_id", F.col("point2d_idx").cast("long").alias("point2d_idx"), at(1, "double").alias("u"), at(2, "double").alias("v"), at(3, "long").alias("point3d_id"))
    p = _records(spark, f"{root}/*/points3D.txt", 1).withColumn("f", split("value"))
    points = p.select("scene_id", word(1, "long").alias("point3d_id"), *[word(k).alias(n) for k, n in ((2, "x"), (3, "y"), (4, "z"))], *[word(k, "int").alias(n) for k, n in ((5, "r"), (6, "g"), (7, "b"))], word(8).alias("error"), F.expr("cast((size(f) - 8) / 2 as long)").alias("track_length"))
    return cameras, images.drop("rest"), points, observations


def read_colmap(spark: SparkSession, root: str) -> tuple[tuple[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]:
    """The four tables of each scene's text model, or its binary one where it has no text; and the scenes with neither whole."""
    at = F.col("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.element_at(F.split(at, "/"), -2).alias("scene_id"), F.element_at(F.split(at, "/"), -1).alias("file"))
    whole = lambda end: (F.count_if(F.col("file").isin(f"cameras.{end}", f"images.{end}", f"points3D.{end}")) == 3)
    scenes = files.groupBy("scene_id").agg(whole("txt").alias("text"), whole("bin").alias("binary"))
    kinds = scenes.agg(F.bool_or("text").alias("t"), F.bool_or(F.col("binary") & ~F.col("text")).alias("b")).first()
    parts = []
    if kinds["t"]:
        parts.append([t.join(scenes.filter("text"), "scene_id", "left_semi") for t in read_colmap_text(spark, root)])
    if kinds["b"]:
        parts.append([t.join(scenes.filter("binary AND NOT text"), "scene_id", "left_semi") for t in read_colmap_bin(spark, root)])
    if not parts:
        raise ValueError(f"no scene under {root} has a whole model")
    tables = tuple(a if len(parts) == 1 else a.unionByName(parts[1][k]) for k, a in enumerate(parts[0]))
    return tables, scenes.filter("NOT text AND NOT binary").select("scene_id")


def write_colmap_text(cameras: DataFrame, images: DataFrame, points: DataFrame, observations: DataFrame, path: str) -> None:
    """Text models, ``path``/<scene>/cameras.txt, images.txt and points3D.txt, with observations and tracks."""
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    seen = observations.groupBy("scene_id", "image_id").agg(F.array_sort(F.collect_list(F.struct("point2d_idx", "u", "v", "point3d_id"))).alias("o"))
    marks = F.array_join(F.transform("o", lambda x: F.concat_ws(" ", x["u"], x["v"], x["point3d_id"])), " ")
    track = observations.filter("point3d_id <> -1").groupBy("scene_id", "point3d_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "point2d_idx"))).alias("t"))
    steps = F.array_join(F.transform("t", lambda x: F.concat_ws(" ", x["image_id"], x["point2d_idx"])), " ")
    i = images.join(seen, ["scene_id", "image_id"], "left")
    p = points.join(track, ["scene_id", "point3d_id"], "left")
    tables = {
        "cameras.txt": (cameras.select("scene_id", F.col("camera_id").alias("k"), F.concat_ws(" ", "camera_id", "model", "width", "height", flat("params")).alias("value")), "# CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]\n"),
        "images.txt": (i.select("scene_id", F.col("image_id").alias("k"), F.concat(F.concat_ws(" ", "image_id", flat("qvec"), flat("tvec"), "camera_id", "name"), F.lit("\n"), F.coalesce(marks, F.lit(""))).alias("value")), "# IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME\n# POINTS2D[] as (X, Y, POINT3D_ID)\n"),
        "points3D.txt": (p.select("scene_id", F.col("point3d_id").alias("k"), F.concat_ws(" ", "point3d_id", "x", "y", "z", "r", "g", "b", "error", steps).alias("value")), "# POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)\n"),
    }
    for name, (rows, head) in tables.items():

        def lines(scene: str, own: Iterator, head: str = head) -> Iterator[bytes]:
            yield head.encode()
            for r in own:
                yield f"{r.value}\n".encode()

        write_files(rows, path, name, lines, ["k"])


_PLY = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int": "i4", "uint": "u4", "short": "i2", "ushort": "u2"}


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of ASCII and little-endian PLY files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                head, body = data.split(b"end_header\n", 1)
                lines = head.decode("ascii").split("\n")
                n = next(int(x.split()[2]) for x in lines if x.startswith("element vertex"))
                kind = np.dtype([(x.split()[2], "<" + _PLY[x.split()[1]]) for x in lines if x.startswith("property") and "list" not in x])
                if any("ascii" in x for x in lines[:3]):
                    rows = np.array([tuple(float(v) for v in x.split()[: len(kind.names)]) for x in body.decode("ascii").split("\n")[:n]], dtype=kind)
                else:
                    rows = np.frombuffer(body, kind, n)
                out = pd.DataFrame({"scene_id": [name.split("/")[-2]] * n})
                for c in "xyz":
                    out[c] = rows[c].astype(float)
                for c, long in (("r", "red"), ("g", "green"), ("b", "blue")):
                    out[c] = rows[long].astype("int32") if long in kind.names else 255
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "scene_id string, x double, y double, z double, r int, g int, b int")


def write_ply(points: DataFrame, path: str, name: str = "points.ply") -> None:
    """ASCII PLY, ``path``/<scene>/``name``: the header has the scene's count, the points follow in order of id."""
    n = points.groupBy("scene_id").agg(F.count("*").alias("n"))
    rows = points.join(n, "scene_id").select("scene_id", "point3d_id", "n", "x", "y", "z", "r", "g", "b")
    head = "ply\nformat ascii 1.0\nelement vertex {}\n" + "".join(f"property {t} {c}\n" for t, c in (("float", "x"), ("float", "y"), ("float", "z"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue"))) + "end_header\n"

    def lines(scene: str, own: Iterator) -> Iterator[bytes]:
        for k, r in enumerate(own):
            if not k:
                yield head.format(r.n).encode()
            yield f"{r.x} {r.y} {r.z} {r.r} {r.g} {r.b}\n".encode()

    write_files(rows, path, name, lines, ["point3d_id"])


def write_splat_ply(splats: DataFrame, path: str, order: str = "splat_id", name: str = "splat.ply") -> None:
    """Binary little-endian PLY, ``path``/<scene>/``name``: the columns in order as properties, bytes as uchar, other numbers as float.

    Rows without a value in some column are refused, as every property has one for each vertex.
    """
    columns = [c for c in splats.columns if c not in ("scene_id", order)]
    small = {f.name for f in splats.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType))}
    if splats.filter(F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)).limit(1).count():
        raise ValueError("every property needs a value for each vertex")
    n = splats.groupBy("scene_id").agg(F.count("*").alias("n_vertices"))
    kinds = "<" + "".join("B" if c in small else "f" for c in columns)
    head = "ply\nformat binary_little_endian 1.0\ncomment Vertical Axis: z\nelement vertex {}\n" + "".join(f"property {'uchar' if c in small else 'float'} {c}\n" for c in columns) + "end_header\n"

    def vertices(scene: str, own: Iterator) -> Iterator[bytes]:
        for k, r in enumerate(own):
            if not k:
                yield head.format(r[2]).encode()
            yield struct.pack(kinds, *[int(x) if c in small else x for c, x in zip(columns, r[3:], strict=True)])

    write_files(splats.join(n, "scene_id").select("scene_id", order, "n_vertices", *columns), path, name, vertices, [order])


def read_polycam(spark: SparkSession, path: str, least_blur: float, crop: int = 0) -> DataFrame:
    """Per-frame JSON; blurred frames go, a border shifts the principal point, axes turn."""
    names = [f"t_{i}{j}" for i in range(3) for j in range(4)]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("fx", "fy", "cx", "cy", "width", "height", "blur_score", *names)])
    f = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("frame", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.json$", 1))
    f = f.filter(F.col("blur_score").isNull() | (F.col("blur_score") >= least_blur))
    turned = [F.col(f"t_{i}{j}") for i in (2, 0, 1) for j in range(4)]
    return f.select("frame", "fx", "fy", (F.col("cx") - crop).alias("cx"), (F.col("cy") - crop).alias("cy"), (F.col("width") - 2 * crop).alias("w"), (F.col("height") - 2 * crop).alias("h"), F.array(*turned).alias("c2w"))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files under a folder, hidden ones left out, numbered in order of path; contents are not read."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("png", "jpg", "jpeg", "tif", "tiff"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    by = Window.partitionBy(folder).orderBy("path")
    return files.withColumn("number", F.row_number().over(by)).withColumn("name", F.concat(F.format_string("frame_%05d.", "number"), F.lower(F.regexp_extract("path", r"([^.]+)$", 1))))


def write_transforms(frames: DataFrame, path: str, scenes: DataFrame | None = None) -> None:
    """``path``/<scene>/transforms.json with frames in file order.

    Intrinsics (those of ``NUMBERS`` and camera_model that ``frames`` has) go to the
    top where the scene's only camera is number 1, else to each frame; the model,
    of which a scene has one, always to the top.
    ``scenes`` may have (scene_id, applied_transform), a 3x4.
    """
    have = [c for c in ("camera_model", *NUMBERS) if c in frames.columns]
    matrix = F.array(*[F.slice("c2w", 4 * i + 1, 4) for i in range(3)], F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))
    f = frames.withColumn("camera_id", F.col("camera_id") if "camera_id" in frames.columns else F.lit(0))
    one = f.groupBy("scene_id").agg((F.array_sort(F.collect_set("camera_id")) == F.array(F.lit(1).cast(dict(f.dtypes)["camera_id"]))).alias("one"))
    if scenes is not None:
        one = one.join(scenes.select("scene_id", F.array(*[F.slice("applied_transform", 4 * i + 1, 4) for i in range(3)]).alias("applied_transform")), "scene_id", "left")
    f = f.join(one, "scene_id")
    own = F.struct(*[F.when(~F.col("one"), F.col(c)).alias(c) for c in have if c != "camera_model"], "file_path", matrix.alias("transform_matrix"))
    top = F.struct(*[(F.col(c) if c == "camera_model" else F.when(F.col("one"), F.col(c))).alias(c) for c in have], *([F.col("applied_transform")] if scenes is not None else []))
    rows = f.select("scene_id", "file_path", F.to_json(own).alias("frame"), F.to_json(top).alias("top"))

    def parts(scene: str, found: Iterator) -> Iterator[bytes]:
        for k, r in enumerate(found):
            if not k:
                yield (r.top[:-1] + ("," if r.top != "{}" else "") + '"frames":[\n').encode()
            yield ((",\n" if k else "") + r.frame).encode()
        yield b"\n]}\n"

    write_files(rows, path, "transforms.json", parts, ["file_path"])


def write_scene_transforms(scenes: DataFrame, path: str, name: str = "dataparser_transforms.json") -> None:
    """``path``/<scene>/``name`` with the scene's 3x4 ``transform`` and ``scale``."""
    rows = scenes.select("scene_id", F.to_json(F.struct(F.array(*[F.slice("transform", 4 * i + 1, 4) for i in range(3)]).alias("transform"), "scale")).alias("value"))
    write_files(rows, path, name, lambda scene, own: (f"{r.value}\n".encode() for r in own), [])


def read_scene_transforms(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("transform", _MATRIX), T.StructField("scale", T.DoubleType())])
    t = spark.read.schema(schema).option("multiLine", True).json(path)
    return t.select(_scene().alias("scene_id"), F.flatten("transform").alias("transform"), "scale")


def export_poses(frames: DataFrame, path: str) -> None:
    """``path``/<scene>/transforms_train.json and transforms_eval.json: lists of file path and 3x4 pose, in file order."""
    matrix = F.array(*[F.slice("c2w", 4 * i + 1, 4) for i in range(3)])
    for split in ("train", "eval"):
        rows = frames.filter(F.col("split") == split).select("scene_id", "file_path", F.to_json(F.struct("file_path", matrix.alias("transform"))).alias("value"))

        def parts(scene: str, own: Iterator) -> Iterator[bytes]:
            yield b"["
            for k, r in enumerate(own):
                yield ((",\n" if k else "\n") + r.value).encode()
            yield b"\n]\n"

        write_files(rows, path, f"transforms_{split}.json", parts, ["file_path"])


def write_eval(report: DataFrame, path: str) -> None:
    """``path``/<scene>/eval.json of (scene_id, experiment_name, method_name, checkpoint, metric, value) rows."""
    one = report.groupBy("scene_id", "experiment_name", "method_name", "checkpoint").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("results"))
    rows = one.select("scene_id", F.to_json(F.struct("experiment_name", "method_name", "checkpoint", "results")).alias("value"))
    write_files(rows, path, "eval.json", lambda scene, own: (f"{r.value}\n".encode() for r in own), ["value"])


READERS = {"transforms": read_transforms, "synthetic": read_synthetic, "colmap-text": read_colmap_text, "ply": read_ply, "polycam": read_polycam}
