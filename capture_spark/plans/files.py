"""Registered queries that write capture files from the given tables and read them back, each with a SQL twin over the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capture_spark import shared
from capture_spark.operators import scenes
from capture_spark.plans.captures import POSE, add
from capture_spark.sources import captures, formats, models, plugins
from capture_spark.sources.files import write_files


def fresh(df: DataFrame) -> str:
    """A folder of its own in the shared one."""
    return f"{shared.folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


# Structure-from-motion models


def model(cams: DataFrame, frames: DataFrame, points: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables of a model: pinhole cameras, images that turn by their yaw, points and what images see of them."""
    c = cams.select("scene_id", "camera_id", F.lit("PINHOLE").alias("model"), "width", "height", F.array("fx", "fy", "cx", "cy").alias("params"))
    i = frames.select("scene_id", F.col("frame_id").alias("image_id"), F.array(F.cos(F.col("yaw") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.col("yaw") / 2)).alias("qvec"), F.array("tx", "ty", "tz").alias("tvec"), "camera_id", F.col("file_path").alias("name"))
    return c, i, points, observations.select("scene_id", "image_id", "point2d_idx", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), "point3d_id")


MODEL = "cameras frames points3d observations"
TABLES = {
    "cameras": ("scene_id camera_id model width height", "fx fy cx cy", lambda t: t.withColumns({c: F.col("params")[k] for k, c in enumerate(("fx", "fy", "cx", "cy"))}),
                "SELECT CAST(scene_id AS VARCHAR) AS scene_id, camera_id, 'PINHOLE' AS model, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, fx, fy, cx, cy FROM cameras"),
    "images": ("scene_id image_id camera_id name", "qw qx qy qz x y z", lambda t: t.withColumns({c: F.col("qvec")[k] for k, c in enumerate(("qw", "qx", "qy", "qz"))} | {c: F.col("tvec")[k] for k, c in enumerate("xyz")}),
               "SELECT CAST(scene_id AS VARCHAR) AS scene_id, CAST(frame_id AS BIGINT) AS image_id, CAST(camera_id AS BIGINT) AS camera_id, file_path AS name, cos(yaw/2) AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, sin(yaw/2) AS qz, tx AS x, ty AS y, tz AS z FROM frames"),
    "points": ("scene_id point3d_id r g b track_length", "x y z error", lambda t: t,
               "SELECT CAST(p.scene_id AS VARCHAR) AS scene_id, p.point3d_id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, coalesce(n, 0) AS track_length, x, y, z, error FROM points3d p LEFT JOIN (SELECT o.scene_id, o.point3d_id, count(*) AS n FROM observations o JOIN frames f ON f.scene_id = o.scene_id AND f.frame_id = o.image_id GROUP BY 1, 2) t ON t.scene_id = p.scene_id AND t.point3d_id = p.point3d_id"),
    "observations": ("scene_id image_id point2d_idx point3d_id", "u v", lambda t: t,
                     "SELECT CAST(o.scene_id AS VARCHAR) AS scene_id, CAST(image_id AS BIGINT) AS image_id, point2d_idx, o.point3d_id, CAST(u AS DOUBLE) AS u, CAST(v AS DOUBLE) AS v FROM observations o JOIN frames f ON f.scene_id = o.scene_id AND f.frame_id = o.image_id"),
}
ORDER = ("cameras", "images", "points", "observations")


def _model_query(write: Callable[..., None], read: Callable[..., tuple[DataFrame, ...]], table: str) -> Callable[..., DataFrame]:
    def build(*views: DataFrame) -> DataFrame:
        where = fresh(views[0])
        write(*model(*views), where)
        return TABLES[table][2](read(views[0].sparkSession, where)[ORDER.index(table)])

    return build


for _table, (_keys, _doubles, _, _sql) in TABLES.items():
    add(f"s03_s06_text_{_table}", MODEL, _model_query(captures.write_colmap_text, captures.read_colmap_text, _table), _keys, _doubles, _sql)
    # Ranges of 4 KB, so that files of the small tables are read by many tasks as large ones would be.
    add(f"s04_binary_{_table}", MODEL, _model_query(models.write_colmap_bin, lambda s, at: models.read_colmap_bin(s, at, 4096), _table), _keys, _doubles, _sql)


def _either(*views: DataFrame) -> DataFrame:
    """Some scenes with text, some with binary files, some with both, some without points: (scene_id, image_id, kind)."""
    where, spark = fresh(views[0]), views[0].sparkSession
    tables = model(*views)
    of = lambda keep: [t.filter(keep) for t in tables]
    captures.write_colmap_text(*of("scene_id % 4 IN (0, 2)"), where)
    moved = tables[1].withColumn("name", F.concat(F.lit("bin/"), "name"))
    models.write_colmap_bin(*[(moved if t is tables[1] else t).filter("scene_id % 4 IN (1, 2)") for t in tables], where)
    write_files(tables[0].filter("scene_id % 4 = 3").select("scene_id", "camera_id"), where, "cameras.txt", lambda scene, own: (b"%d SIMPLE_PINHOLE 1 1 1 0 0\n" % r.camera_id for r in own), ["camera_id"])
    (_, images, _, _), rejects = captures.read_colmap(spark, where)
    got = images.select("scene_id", "image_id", F.when(F.startswith("name", F.lit("bin/")), "binary").otherwise("text").alias("kind"))
    return got.unionByName(rejects.select("scene_id", F.lit(None).cast("long").alias("image_id"), F.lit("neither").alias("kind")))


add("s05_text_or_binary", MODEL, _either, "scene_id image_id kind", "",
    "SELECT CAST(scene_id AS VARCHAR) AS scene_id, CAST(frame_id AS BIGINT) AS image_id, CASE WHEN scene_id % 4 = 1 THEN 'binary' ELSE 'text' END AS kind FROM frames WHERE scene_id % 4 <> 3 UNION ALL SELECT DISTINCT CAST(scene_id AS VARCHAR), NULL, 'neither' FROM cameras WHERE scene_id % 4 = 3")


def _collection(frames: DataFrame, cams: DataFrame, points: DataFrame, observations: DataFrame) -> DataFrame:
    """A photo collection: a camera for each image, pinhole but for those of the rig's first."""
    where = fresh(frames)
    c, i, p, o = model(cams, frames, points, observations)
    own = c.join(i.select("scene_id", "camera_id", "image_id"), ["scene_id", "camera_id"])
    own = own.withColumns({"model": F.when(F.col("camera_id") == 0, "SIMPLE_PINHOLE").otherwise(F.col("model")), "params": F.when(F.col("camera_id") == 0, F.slice("params", 2, 3)).otherwise(F.col("params"))})
    models.write_colmap_bin(own.drop("camera_id").withColumnRenamed("image_id", "camera_id"), i, p, o, where)
    f = formats.read_phototourism(frames.sparkSession, where)
    return f.withColumns({f"e{k}": F.element_at("c2w", k) for k in (1, 2, 4, 5, 6, 8, 11, 12)})


add("s23_phototourism", "frames cameras points3d observations", _collection, "scene_id image_id file_path width height", "fx fy cx cy e1 e2 e4 e5 e6 e8 e11 e12",
    "SELECT CAST(f.scene_id AS VARCHAR) AS scene_id, CAST(frame_id AS BIGINT) AS image_id, file_path, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, fx, fy, cx, cy, cos(yaw) AS e1, -sin(yaw) AS e2, -(cos(yaw)*tx+sin(yaw)*ty) AS e4, -sin(yaw) AS e5, -cos(yaw) AS e6, sin(yaw)*tx-cos(yaw)*ty AS e8, -1.0::DOUBLE AS e11, -tz AS e12 FROM frames f JOIN cameras c ON c.scene_id = f.scene_id AND c.camera_id = f.camera_id WHERE f.camera_id <> 0")


# Data sources


def _frames_with_lens(frames: DataFrame, cams: DataFrame) -> DataFrame:
    f = scenes.with_pose(frames).join(cams, ["scene_id", "camera_id"])
    lens = {"fl_x": "fx", "fl_y": "fy", "w": "width", "h": "height"}
    return f.select("scene_id", "file_path", F.lit("OPENCV").alias("camera_model"), *[F.col(old).cast("double").alias(c) for c, old in lens.items()], "cx", "cy", "c2w")


def _frames_source(frames: DataFrame, cams: DataFrame) -> DataFrame:
    where, spark = fresh(frames), frames.sparkSession
    plugins.register(spark)
    _frames_with_lens(frames, cams).repartition("scene_id").sortWithinPartitions("scene_id", "file_path").write.format("capture_frames").mode("append").save(where)
    got = spark.read.format("capture_frames").load(where)
    return got.withColumns({f"e{k}": F.element_at("c2w", k) for k in (1, 4, 7, 10, 12)})


FRAMES = f"SELECT CAST(scene_id AS VARCHAR) AS scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY file_path) - 1 AS INTEGER) AS pos, file_path, 'OPENCV' AS camera_model, fx AS fl_x, fy AS fl_y, cx, cy, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, a00 AS e1, tx AS e4, a12 AS e7, a21 AS e10, tz AS e12 FROM {POSE} JOIN cameras USING (scene_id, camera_id)"
add("u02_frames_source", "frames cameras", _frames_source, "scene_id pos file_path camera_model", "fl_x fl_y cx cy w h e1 e4 e7 e10 e12", FRAMES)


def _model_source(table: str) -> Callable[..., DataFrame]:
    def build(*views: DataFrame) -> DataFrame:
        where, spark = fresh(views[0]), views[0].sparkSession
        models.write_colmap_bin(*model(*views), where)
        models.write_ranges(spark, where, 4096)
        plugins.register(spark)
        return TABLES[table][2](spark.read.format("capture_model").option("table", table).load(where))

    return build


for _table in ("points", "observations"):
    add(f"u02_model_source_{_table}", MODEL, _model_source(_table), *TABLES[_table][:2], TABLES[_table][3])
