"""Plans that have to hold for large inputs, whatever Spark takes the size of small ones for."""

import math

from pyspark.sql import functions as F

from capture_spark.operators import scenes
from capture_spark.sources import formats, models


def test_collections_send_no_cameras_to_all(spark, tmp_path):
    ids = spark.range(40).select(F.lit("s").alias("scene_id"), F.col("id").alias("image_id"))
    cameras = ids.select("scene_id", F.col("image_id").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(8).alias("width"), F.lit(6).alias("height"), F.expr("array(5D, 5D, 4D, 3D)").alias("params"))
    images = ids.select("scene_id", "image_id", F.expr("array(1D, 0D, 0D, 0D)").alias("qvec"), F.expr("array(0D, 0D, 0D)").alias("tvec"), F.col("image_id").alias("camera_id"), F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("name"))
    points = ids.select("scene_id", F.col("image_id").alias("point3d_id"), *[F.lit(0.0).alias(c) for c in "xyz"], *[F.lit(1).alias(c) for c in "rgb"], F.lit(0.5).alias("error"))
    seen = ids.select("scene_id", "image_id", F.lit(0).cast("long").alias("point2d_idx"), F.lit(1.0).alias("u"), F.lit(2.0).alias("v"), F.col("image_id").alias("point3d_id"))
    models.write_colmap_bin(cameras, images, points, seen, f"{tmp_path}/m")
    frames = formats.read_phototourism(spark, f"{tmp_path}/m")
    assert sorted(r["image_id"] for r in frames.collect()) == list(range(40))
    assert "Broadcast" not in frames._jdf.queryExecution().executedPlan().toString()


def test_places_of_a_scene_come_from_many_tasks(spark, monkeypatch):
    names = [(s, f"{(k * 37) % 101:03d}") for s, n in ((1, 100), (2, 1), (None, 30)) for k in range(n)]
    frames = spark.createDataFrame(names, "scene_id long, file_path string")
    monkeypatch.setattr(scenes, "PART", 16, raising=False)
    got = scenes.placed(frames)
    assert "windowspecdefinition(scene_id" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(s, f): (sorted(x for t, x in names if t == s).index(f), sum(t == s for t, _ in names)) for s, f in names}
    assert {(r["scene_id"], r["file_path"]): (r["idx"], r["n"]) for r in got.collect()} == want
    tasks = {r["task"] for r in got.filter("scene_id = 1").select(F.spark_partition_id().alias("task")).distinct().collect()}
    assert len(tasks) > 1 and dict(got.dtypes) == {"scene_id": "bigint", "file_path": "string", "idx": "bigint", "n": "bigint"}


def test_split_by_steps_makes_no_rows(spark):
    for fraction in (0.0, 0.1, 0.3, 0.8, 0.9, 1.0, 1.7):
        sizes = (1, 2, 3, 7, 10, 49, 100, 333)
        frames = spark.createDataFrame([(n, f"{k:04d}") for n in sizes for k in range(n)], "scene_id long, file_path string")
        got = scenes.split_fraction(frames, fraction)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortMergeJoin" not in plan
        found = {(r["scene_id"], r["idx"]) for r in got.collect() if r["split"] == "train"}
        want = set()
        for n in sizes:
            m = math.ceil(n * fraction)
            want |= {(n, n - 1 if j == m - 1 and m > 1 else math.floor(j * ((n - 1) / max(m - 1, 1)))) for j in range(max(m, 1))}
        assert found == want
