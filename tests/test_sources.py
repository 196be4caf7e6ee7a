"""Data sources and binary models: planning, discovery, writes that fail, files that are cut short."""

import json
import struct
import sys
import warnings

import pytest
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader

from capture_spark.sources import models, plugins


@pytest.fixture(scope="module")
def tables(spark):
    cams = spark.createDataFrame([("a", 1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), ("b", 7, "OPENCV", 10, 20, [float(k) for k in range(8)])], "scene_id string, camera_id long, model string, width long, height long, params array<double>")
    images = spark.createDataFrame([(s, i, [1.0, 0.0, 0.0, float(i)], [0.1 * i, 2.0, 3.0], 1, f"über {i}.png" if i else "") for s in "ab" for i in range(5)], "scene_id string, image_id long, qvec array<double>, tvec array<double>, camera_id long, name string")
    points = spark.createDataFrame([(s, p, p / 3, -p / 7, 1.0 + p, p % 256, 3, 255, 0.5) for s in "ab" for p in range(60)], "scene_id string, point3d_id long, x double, y double, z double, r int, g int, b int, error double")
    seen = spark.createDataFrame([(s, i, k, 0.25 * k, 1.5 * i, (k * 7 + i) % 60 if k % 3 else -1) for s in "ab" for i in range(4) for k in range(20)], "scene_id string, image_id long, point2d_idx long, u double, v double, point3d_id long")
    return cams, images, points, seen


@pytest.fixture(scope="module")
def model(tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    models.write_colmap_bin(*tables, root)
    return root


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_binary_model_by_ranges(spark, tables, model, size):
    cams, images, points, seen = tables
    got = models.read_colmap_bin(spark, model, size)
    assert rows(got[0]) == rows(cams, *got[0].columns)
    assert rows(got[1]) == rows(images, *got[1].columns)
    assert rows(got[3]) == rows(seen, *got[3].columns)
    tracks = {(r["scene_id"], r["point3d_id"]): r["n"] for r in seen.groupBy("scene_id", "point3d_id").count().withColumnRenamed("count", "n").collect()}
    assert rows(got[2]) == sorted(((*r, tracks.get(r[:2], 0)) for r in map(tuple, points.collect())), key=str)


def test_ranges_hold_whole_records(model):
    path = f"{model}/a/points3D.bin"
    for size in (1, 60, 500, 1 << 20):
        found = list(models.ranges(path, "points", size))
        assert [x[0] for x in found] == [8, *[x[1] for x in found[:-1]]] and sum(x[2] for x in found) == 60
        assert all(b - a >= size for a, b, _ in found[:-1])
    assert len(list(models.ranges(path, "points", 1))) == 60


def test_empty_and_cut_files(spark, tmp_path):
    for scene, data in (("none", struct.pack("<Q", 0)), ("one", struct.pack("<Q", 1) + struct.pack("<QdddBBBdQ", 5, 1, 2, 3, 4, 5, 6, 0.5, 0))):
        (tmp_path / scene).mkdir()
        (tmp_path / scene / "points3D.bin").write_bytes(data)
    assert rows(models.read_colmap_points_bin(spark, f"{tmp_path}/*/points3D.bin"), "scene_id", "point3d_id") == [("one", 5)]
    for cut in (3, 20):
        (tmp_path / "one" / "points3D.bin").write_bytes(data[:-cut])
        with pytest.raises(ValueError, match="ends inside"):
            list(models.ranges(str(tmp_path / "one" / "points3D.bin"), "points"))


def test_model_source_plans_ranges(spark, tables, model):
    plugins.register(spark)
    read = lambda table, **more: spark.read.format("capture_model").options(table=table, **more).load(model)
    assert read("points").rdd.getNumPartitions() == 2  # a file each
    models.write_ranges(spark, model, 500)
    assert read("points").rdd.getNumPartitions() > 6
    for table, k in (("cameras", 0), ("images", 1), ("points", 2), ("observations", 3)):
        assert rows(read(table)) == rows(models.read_colmap_bin(spark, model)[k])
    assert {r["scene_id"] for r in read("points", scenes="b").collect()} == {"b"}
    assert read("points", scenes="missing").count() == 0
    with pytest.raises(Exception, match="table is one of"):
        read("tracks").collect()


FRAME = "scene_id string, file_path string, fl_x double, c2w array<double>"


def test_frames_source_writes_and_reads(spark, tmp_path):
    plugins.register(spark)
    df = spark.createDataFrame([(s, f"{k}.png", 1.5 if k else None, [float(k + j) for j in range(12)]) for s in "ab" for k in range(5)], FRAME)
    ready = df.repartition("scene_id").sortWithinPartitions("scene_id", "file_path")
    ready.write.format("capture_frames").mode("append").save(str(tmp_path))
    got = spark.read.format("capture_frames").load(str(tmp_path))
    assert rows(got, "scene_id", "file_path", "fl_x", "c2w") == rows(df)
    assert json.loads((tmp_path / "a" / "transforms.json").read_text())["frames"][1]["transform_matrix"][3] == [0, 0, 0, 1]
    with pytest.raises(Exception, match="there already"):
        ready.write.format("capture_frames").mode("append").save(str(tmp_path))
    ready.filter("file_path < '2'").write.format("capture_frames").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("capture_frames").option("scenes", "b").load(str(tmp_path)).count() == 2
    before = sorted(p.name for p in tmp_path.rglob("*"))
    with pytest.raises(Exception, match="several tasks"):
        df.repartition(4, "file_path").sortWithinPartitions("scene_id").write.format("capture_frames").mode("overwrite").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*")) == before  # a write that fails leaves nothing


class Counted(DataSource):
    """A format as another package would bring it: a JSON file with a number of rows."""

    @classmethod
    def name(cls):
        return "counted"

    def schema(self):
        return "n int"

    def reader(self, schema):
        with open(self.options["path"]) as f:
            return CountedReader(json.load(f))


class CountedReader(DataSourceReader):
    def __init__(self, n):
        self.n = n

    def read(self, partition):
        yield from ((k,) for k in range(self.n))


def not_a_source():
    return 1


def test_formats_of_other_packages(spark, tmp_path, monkeypatch):
    info = tmp_path / "other-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text("Metadata-Version: 2.1\nName: other\nVersion: 1.0\n")
    here = __name__
    (info / "entry_points.txt").write_text(f"[{plugins.GROUP}]\ncounted = {here}:Counted\nwrong = {here}:not_a_source\ngone = nowhere:Format\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setitem(sys.modules, here, sys.modules[__name__])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            every = plugins.register(spark)
        assert {"capture_frames", "capture_model", "counted"} <= set(every)
        assert {"wrong", "gone"} == {str(w.message).split()[1] for w in said if "format" in str(w.message)}
        (tmp_path / "n.json").write_text("3")
        assert spark.read.format("counted").load(str(tmp_path / "n.json")).count() == 3
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_formats_by_variable(monkeypatch):
    monkeypatch.setenv(plugins.VARIABLE, f"counted={__name__}:Counted,, other={__name__}:Counted")
    with pytest.warns(UserWarning, match="calls itself counted"):
        assert plugins.found() == {"counted": Counted}


def test_small_ranges_share_tasks(spark, tables, tmp_path):
    """Ranges are read by as many tasks as there are bytes for, not by one task each, and neighbours at once."""
    c, i, _, o = tables
    many = spark.range(40000).selectExpr("CAST(id % 2 AS STRING) AS scene_id", "id AS point3d_id", "id * 0.5D AS x", "0.0D AS y", "1.0D AS z", "1 AS r", "2 AS g", "3 AS b", "0.25D AS error")
    models.write_colmap_bin(c, i, many, o, str(tmp_path))
    got = models.read_model_table(spark, f"{tmp_path}/*/points3D.bin", "points", 512)
    assert got.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    want = {(str(k % 2), k, k * 0.5) for k in range(40000)}
    assert {(r["scene_id"], r["point3d_id"], r["x"]) for r in got.collect()} == want
    models.write_ranges(spark, str(tmp_path), 512)
    plugins.register(spark)
    again = spark.read.format("capture_model").option("table", "points").load(str(tmp_path))
    assert 2 < again.rdd.getNumPartitions() <= 2 * plugins.SPREAD
    assert {(r["scene_id"], r["point3d_id"], r["x"]) for r in again.collect()} == want
    assert list(models.joined([(0, 4), (4, 8), (9, 12), (12, 30), (30, 31)], 8)) == [(0, 8), (9, 12), (12, 30), (30, 31)]


def test_frames_are_read_one_by_one(tmp_path, monkeypatch):
    """A file's frames are never one value: members in any order, long and short reads, signs of many bytes cut anywhere."""
    frames = [{"file_path": f"ü{k % 7}/{k:04d}.png", "fl_x": k / 3, "k1": None, "transform_matrix": [[float(k), 0, 1e-3, -2], [0, 1, 0, 5], [0, 0, 1, 6], [0, 0, 0, 1]]} for k in range(500)]
    want = sorted(f["file_path"] for f in frames)
    most = []
    real = json.JSONDecoder.raw_decode
    monkeypatch.setattr(json.JSONDecoder, "raw_decode", lambda self, text, at=0: (most.append(len(text)), real(self, text, at))[1])
    for name, data in {"a": {"w": 640, "frames": frames, "h": 1.5}, "b": {"frames": frames, "camera_model": "X", "more": {"frames": [1]}, "w": 12}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "transforms.json").write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")
        for size in (1, 1 << 16):
            most.clear()
            with open(tmp_path / name / "transforms.json", "rb") as f:
                got = list(plugins._members(f, size))
            assert [v for k, v in got if k == "frames"] == frames and {k: v for k, v in got if k != "frames"} == {k: v for k, v in data.items() if k != "frames"}
            assert max(most) < 3 * max(size, 600)
        rows_ = list(plugins.FramesReader([]).read(plugins.Files([str(tmp_path / name / "transforms.json")])))
        assert [r[2] for r in rows_] == want and [r[1] for r in rows_] == list(range(500))
        first = min(frames, key=lambda x: x["file_path"])
        assert rows_[0][4] == first["fl_x"] and rows_[0][10] is None and rows_[0][8] == data["w"] and rows_[0][-1][:4] == first["transform_matrix"][0]
    (tmp_path / "a" / "transforms.json").write_text('{"frames": [{"file_path": "x"')
    with pytest.raises(ValueError):
        list(plugins.FramesReader([]).read(plugins.Files([str(tmp_path / "a" / "transforms.json")])))
