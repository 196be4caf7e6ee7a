"""Binary structure-from-motion models, read by ranges of bytes.

Records have any length, so a place in a file says nothing about where a record
starts.  One pass over a file, block by block, cuts it into ranges of whole records;
the ranges are dealt over the cluster, and each is read by itself.  So no file is
one value, and a model of many gigabytes is many tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.sources.files import opened, write_files

#: The camera models of the format by number, with their number of parameters.
BINARY_MODELS = ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12)
FILES = {"cameras": "cameras.bin", "images": "images.bin", "observations": "images.bin", "points": "points3D.bin"}
SCHEMAS = {
    "cameras": "scene_id string, camera_id long, model string, width long, height long, params array<double>",
    "images": "scene_id string, image_id long, qvec array<double>, tvec array<double>, camera_id long, name string",
    "observations": "scene_id string, image_id long, point2d_idx long, u double, v double, point3d_id long",
    "points": "scene_id string, point3d_id long, x double, y double, z double, r int, g int, b int, error double, track_length long",
}
RANGE = 8 << 20  # bytes of a range, but for a longer record
BLOCK = 1 << 20  # bytes read at once where records are only counted
SIDECAR = ".ranges"
_COUNT, _CAMERA, _IMAGE = "<Q", "<iiQQ", "<I7dI"
_CAMERA_SIZE, _IMAGE_SIZE = struct.calcsize(_CAMERA), struct.calcsize(_IMAGE)
_POINT = np.dtype([("point3d_id", "<u8"), ("xyz", "<f8", 3), ("rgb", "u1", 3), ("error", "<f8"), ("track", "<u8")])
_STEP = np.dtype([("image_id", "<i4"), ("point2d_idx", "<i4")])
_MARK = np.dtype([("u", "<f8"), ("v", "<f8"), ("point3d_id", "<i8")])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Window:
    """Bytes of an open file, of which one block is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, min(BLOCK, self.size - at)), at)
        got = self.held[at - self.at : at - self.at + n]
        if len(got) < n:
            raise ValueError(f"the file ends inside a record, at byte {at + len(got)}")
        return got

    def zero(self, at: int) -> int:
        """Where the next zero byte is."""
        while True:
            chunk = self.get(at, min(256, self.size - at))
            if (k := chunk.find(b"\0")) >= 0:
                return at + k
            if at + len(chunk) >= self.size:
                raise ValueError("the file ends inside a name")
            at += len(chunk)


def _length(kind: str, w: Window, at: int) -> int:
    """Bytes of the record at a place."""
    if kind == "cameras":
        return _CAMERA_SIZE + 8 * BINARY_MODELS[struct.unpack(_CAMERA, w.get(at, _CAMERA_SIZE))[1]][1]
    if kind == "points":
        return _POINT.itemsize + 8 * struct.unpack(_COUNT, w.get(at + _POINT.itemsize - 8, 8))[0]
    end = w.zero(at + _IMAGE_SIZE)
    return end + 9 - at + _MARK.itemsize * struct.unpack(_COUNT, w.get(end + 1, 8))[0]


def ranges(path: str, kind: str, size: int = RANGE) -> Iterator[tuple[int, int, int]]:
    """(start, end, records) of ranges of whole records, each of ``size`` bytes or the first record past that."""
    where, at_path = place(path)
    with where.open_input_file(at_path) as f:
        w = Window(f, f.size())
        n, start, records = struct.unpack(_COUNT, w.get(0, 8))[0], 8, 0
        at = start
        for _ in range(n):
            at += _length(kind, w, at)
            records += 1
            if at - start >= size:
                yield start, at, records
                start, records = at, 0
        if at > w.size:
            raise ValueError(f"{path} ends inside a record")
        if records:
            yield start, at, records


def joined(cuts: Iterable[tuple[int, int]], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges put together with those that follow them at once, up to ``size`` bytes or one longer range."""
    held = None
    for start, end in cuts:
        if held and held[1] == start and end - held[0] <= size:
            held = held[0], end
        else:
            if held:
                yield held
            held = start, end
    if held:
        yield held


def records(path: str, kind: str, start: int, end: int) -> Iterator[pd.DataFrame]:
    """The rows of a range."""
    where, at_path = place(path)
    scene = at_path.split("/")[-2]
    with where.open_input_file(at_path) as f:
        data = f.read_at(end - start, start)
    w = Window(None, len(data))
    w.held = data
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += _length(kind, w, at)
    if kind == "points":
        r = np.frombuffer(data, np.uint8)[np.array(starts)[:, None] + np.arange(_POINT.itemsize)].copy().view(_POINT)[:, 0]
        yield pd.DataFrame({"scene_id": scene, "point3d_id": r["point3d_id"].astype(np.int64), **{c: r["xyz"][:, i] for i, c in enumerate("xyz")}, **{c: r["rgb"][:, i].astype(np.int32) for i, c in enumerate("rgb")}, "error": r["error"], "track_length": r["track"].astype(np.int64)})
    elif kind == "cameras":
        out = []
        for at in starts:
            i, model, width, height = struct.unpack_from(_CAMERA, data, at)
            name, n = BINARY_MODELS[model]
            out.append((scene, i, name, width, height, list(struct.unpack_from(f"<{n}d", data, at + _CAMERA_SIZE))))
        yield pd.DataFrame(out, columns=["scene_id", "camera_id", "model", "width", "height", "params"])
    elif kind == "images":
        out = []
        for at in starts:
            h = struct.unpack_from(_IMAGE, data, at)
            name = data[at + _IMAGE_SIZE : data.index(b"\0", at + _IMAGE_SIZE)].decode()
            out.append((scene, h[0], list(h[1:5]), list(h[5:8]), h[8], name))
        yield pd.DataFrame(out, columns=["scene_id", "image_id", "qvec", "tvec", "camera_id", "name"])
    else:
        ends = [data.index(b"\0", at + _IMAGE_SIZE) for at in starts]
        counts = [struct.unpack_from(_COUNT, data, at + 1)[0] for at in ends]
        r = np.concatenate([np.frombuffer(data, _MARK, n, at + 9) for n, at in zip(counts, ends, strict=True)])
        images, n = np.array([struct.unpack_from("<I", data, at)[0] for at in starts], np.int64), np.array(counts)
        yield pd.DataFrame({"scene_id": scene, "image_id": np.repeat(images, n), "point2d_idx": np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n), **{c: r[c] for c in _MARK.names}})


def read_model_table(spark: SparkSession, path: str, kind: str, size: int = RANGE) -> DataFrame:
    """The ``kind`` table of all model files that ``path`` names, by ranges of ``size`` bytes.

    A file's ranges are found by one task; they are then dealt over the cluster, so
    one large file is read by many tasks.  Neighbours go to one task, up to
    ``RANGE`` bytes of a file, and are read together: small ranges cost no task each.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    whole = files.agg(F.sum("length")).first()[0] or 0
    parallel = spark.sparkContext.defaultParallelism
    together = max(min(RANGE, whole // (4 * parallel)), size)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                found = list(ranges(name, kind, size))
                yield pd.DataFrame({"path": name, "start": [x[0] for x in found], "end": [x[1] for x in found]}, columns=["path", "start", "end"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in b[["path", "start", "end"]].itertuples(index=False, name=None))
        for name, own in groupby(rows, lambda row: row[0]):
            for start, end in joined(row[1:] for row in own):
                yield from records(name, kind, start, end)

    cuts = files.select("path").repartition(parallel, "path").mapInPandas(cut, "path string, start long, end long")
    tasks = int(max(parallel, min(whole // together + 1, 100_000)))
    dealt = cuts.withColumn("part", F.floor(F.col("start") / together)).repartition(tasks, "path", "part").sortWithinPartitions("path", "start")
    return dealt.mapInPandas(read, SCHEMAS[kind])


def read_colmap_points_bin(spark: SparkSession, path: str) -> DataFrame:
    """Points of binary models: little-endian records with tracks of any length."""
    return read_model_table(spark, path, "points")


def read_colmap_bin(spark: SparkSession, root: str, size: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cameras, images, points3d and observations of binary models under ``root``/*/."""
    return tuple(read_model_table(spark, f"{root}/*/{FILES[k]}", k, size) for k in ("cameras", "images", "points", "observations"))


def write_ranges(spark: SparkSession, root: str, size: int = RANGE) -> None:
    """Put a list of the ranges beside each binary file under ``root``/*/, by which the data source plans its partitions."""
    for kind in ("cameras", "images", "points"):
        files = spark.read.format("binaryFile").load(f"{root}/*/{FILES[kind]}").select("path")

        def run(batches: Iterator[pd.DataFrame], kind: str = kind) -> Iterator[pd.DataFrame]:
            for b in batches:
                for name in b["path"]:
                    with opened(name + SIDECAR) as f:
                        f.write(json.dumps(list(ranges(name, kind, size))).encode())
                yield pd.DataFrame({"files": [len(b)]})

        files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "files long").agg(F.sum("files")).collect()


def planned(path: str) -> list[tuple[int, int, int]] | None:
    """The ranges listed beside a file, if they are."""
    where, at = place(path + SIDECAR)
    if where.get_file_info(at).type != fs.FileType.File:
        return None
    with where.open_input_stream(at) as f:
        return [tuple(x) for x in json.loads(f.read())]


def write_colmap_bin(cameras: DataFrame, images: DataFrame, points: DataFrame, observations: DataFrame, path: str) -> None:
    """Binary models, ``path``/<scene>/cameras.bin, images.bin and points3D.bin, with observations and tracks.

    A scene's file is written as a stream in order of id; its number of records comes first.
    """
    numbers = {name: k for k, (name, _) in enumerate(BINARY_MODELS)}
    seen = observations.groupBy("scene_id", "image_id").agg(F.array_sort(F.collect_list(F.struct("point2d_idx", "u", "v", "point3d_id"))).alias("marks"))
    track = observations.filter("point3d_id <> -1").groupBy("scene_id", "point3d_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "point2d_idx"))).alias("track"))

    def camera(b: pa.RecordBatch) -> list[bytes]:
        rows = zip(*[b.column(c).to_pylist() for c in ("camera_id", "model", "width", "height", "params")], strict=True)
        return [struct.pack(_CAMERA, i, numbers[model], width, height) + struct.pack(f"<{len(p)}d", *p) for i, model, width, height, p in rows]

    def image(b: pa.RecordBatch) -> list[bytes]:
        rows = zip(*[b.column(c).to_pylist() for c in ("image_id", "qvec", "tvec", "camera_id", "name")], _lists(b.column("marks"), _MARK), strict=True)
        return [struct.pack(_IMAGE, i, *q, *t, cam) + name.encode() + b"\0" + struct.pack(_COUNT, len(own) // _MARK.itemsize) + own for i, q, t, cam, name, own in rows]

    def point(b: pa.RecordBatch) -> list[bytes]:
        head = np.zeros(b.num_rows, _POINT)
        own = _lists(b.column("track"), _STEP)
        of = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        head["point3d_id"], head["error"], head["track"] = of("point3d_id"), of("error"), [len(x) // _STEP.itemsize for x in own]
        head["xyz"], head["rgb"] = np.column_stack([of(c) for c in "xyz"]), np.column_stack([of(c) for c in "rgb"])
        data, n = head.tobytes(), _POINT.itemsize
        return [data[k * n : k * n + n] + x for k, x in enumerate(own)]

    tables = (
        ("cameras.bin", cameras.select("scene_id", "camera_id", "model", "width", "height", "params"), "camera_id", camera),
        ("images.bin", images.join(seen, ["scene_id", "image_id"], "left").select("scene_id", "image_id", "qvec", "tvec", "camera_id", "name", "marks"), "image_id", image),
        ("points3D.bin", points.join(track, ["scene_id", "point3d_id"], "left").select("scene_id", "point3d_id", "x", "y", "z", "r", "g", "b", "error", "track"), "point3d_id", point),
    )
    for name, rows, key, packed in tables:
        n = rows.groupBy("scene_id").agg(F.count("*").alias("n_records"))

        def run(batches: Iterator[pa.RecordBatch], key: str = key, packed=packed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("scene_id"), b.column(key), pa.array(packed(b), pa.binary())], names=["scene_id", key, "record"])

        def parts(scene: str, own: Iterator) -> Iterator[bytes]:
            for k, r in enumerate(own):
                yield (b"" if k else struct.pack(_COUNT, r.n_records)) + r.record

        done = rows.mapInArrow(run, rows.select("scene_id", key, F.lit(b"").alias("record")).schema)
        write_files(done.join(F.broadcast(n), "scene_id"), path, name, parts, [key])


def _lists(column: pa.Array, kind: np.dtype) -> list[bytes]:
    """The records of each row's list of structs; a null list has none."""
    flat = column.flatten()
    data = np.zeros(len(flat), kind)
    for c in kind.names:
        data[c] = flat.field(c).to_numpy(zero_copy_only=False)
    whole, ends = data.tobytes(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)) * kind.itemsize
    return [whole[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
