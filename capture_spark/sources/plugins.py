"""Capture formats as Spark data sources: two of our own, and those that other packages bring.

A format is a ``DataSource`` class.  Packages name theirs in the entry point group
``capture_spark.formats``; ``CAPTURE_SPARK_FORMATS`` may list more as
``name=module:class``, by commas, and wins over an entry point of the same name.
``register(spark)`` makes all of them known to ``spark.read.format(name)``.
"""

from __future__ import annotations

import codecs
import importlib
import json
import os
import uuid
import warnings
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.metadata import entry_points

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from capture_spark.sources import models

GROUP = "capture_spark.formats"
VARIABLE = "CAPTURE_SPARK_FORMATS"
TASK = 32 << 20  # bytes of small files in a task
SPREAD = 128  # partitions that the files of a model make, if they have as many ranges
# The intrinsics of a frame.
NUMBERS = ("fl_x", "fl_y", "cx", "cy", "w", "h", "k1", "k2", "k3", "k4", "p1", "p2")


@dataclass
class Files(InputPartition):
    """Whole files of one task."""

    paths: list[str]


@dataclass
class Range(InputPartition):
    """Whole ranges of records of one file, in order."""

    path: str
    cuts: list[tuple[int, int]]


def scene_files(root: str, name: str, scenes: list[str] | None) -> list[tuple[str, int]]:
    """(path, size) of ``root``/<scene>/``name`` in order of scene; of some scenes only, if they are named."""
    where, at = models.place(root)
    head = root[: len(root) - len(at)]
    if scenes is None:
        scenes = sorted(x.base_name for x in where.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.Directory)
    found = where.get_file_info([f"{at}/{s}/{name}" for s in scenes])
    return [(head + x.path, x.size) for x in found if x.type == fs.FileType.File]


class CaptureSource(DataSource):
    """A format of one file per scene under ``path``; the option ``scenes``, by commas, leaves the other scenes' files unopened."""

    def root(self) -> str:
        if "path" not in self.options:
            raise ValueError(f"{self.name()}: give the folder of the scenes as path")
        return self.options["path"].rstrip("/")

    def scenes(self) -> list[str] | None:
        named = self.options.get("scenes")
        return None if named is None else [s.strip() for s in named.split(",") if s.strip()]


class FramesSource(CaptureSource):
    """``capture_frames``: frames of transforms.json files; its writer puts one file per scene."""

    @classmethod
    def name(cls) -> str:
        return "capture_frames"

    def schema(self) -> str:
        return "scene_id string, pos int, file_path string, camera_model string, " + ", ".join(f"{c} double" for c in NUMBERS) + ", c2w array<double>"

    def reader(self, schema) -> FramesReader:
        return FramesReader(scene_files(self.root(), "transforms.json", self.scenes()))

    def writer(self, schema, overwrite: bool) -> FramesWriter:
        return FramesWriter(self.root(), schema.fieldNames(), overwrite)


class FramesReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files

    def partitions(self) -> list[Files]:
        """Neighbouring files up to ``TASK`` bytes together."""
        out, size = [Files([])], 0
        for path, n in self.files:
            if out[-1].paths and size + n > TASK:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            where, at = models.place(path)
            names, given, has, poses, top = [], array("d"), bytearray(), array("d"), {}
            with where.open_input_stream(at) as f:
                for key, value in _members(f):
                    if key != "frames":
                        top[key] = value
                        continue
                    names.append(value["file_path"])
                    has.extend(value.get(c) is not None for c in NUMBERS)
                    given.extend(float(value.get(c) or 0.0) for c in NUMBERS)
                    poses.extend(float(x) for row in value["transform_matrix"][:3] for x in row)
            scene, n = at.split("/")[-2], len(NUMBERS)
            for pos, k in enumerate(sorted(range(len(names)), key=names.__getitem__)):
                numbers = [top[c] if c in top else given[k * n + j] if has[k * n + j] else None for j, c in enumerate(NUMBERS)]
                yield (scene, pos, names[k], top.get("camera_model", "OPENCV"), *[None if x is None else float(x) for x in numbers], poses[12 * k : 12 * k + 12].tolist())


def _members(f, size: int = 1 << 16) -> Iterator[tuple[str, object]]:
    """(key, value) of the members of a JSON object, each frame as a member of its own, so that a file is never one value."""
    decoder, utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()
    text, at, done = "", 0, False

    def more() -> None:
        nonlocal text, at, done
        got = f.read(max(size, len(text) - at))  # as much again, so a long value is not tried too often
        done = not got
        text, at = text[at:] + utf8.decode(got, done), 0

    def sign() -> str:
        """The next sign that is no blank, which is left there."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text) or done:
                return text[at : at + 1]
            more()

    def take(signs: str) -> str:
        nonlocal at
        got = sign()
        if not got or got not in signs:
            raise ValueError(f"expected one of {signs} in the file, found {got!r}")
        at += 1
        return got

    def value():
        nonlocal at
        sign()
        while True:
            try:
                made, end = decoder.raw_decode(text, at)
                if end < len(text) or done:  # a number may go on
                    at = end
                    return made
            except json.JSONDecodeError:
                if done:
                    raise
            more()

    take("{")
    if sign() == "}":
        return
    while True:
        key = value()
        take(":")
        if key == "frames":
            take("[")
            if sign() == "]":
                take("]")
            else:
                while True:
                    yield key, value()
                    if take(",]") == "]":
                        break
        else:
            yield key, value()
        if take(",}") == "}":
            return


@dataclass
class Written(WriterCommitMessage):
    """Files of a task by scene, under the names that they have until the write is done."""

    files: dict[str, str]


class FramesWriter(DataSourceArrowWriter):
    """Each task writes its scenes' files under names of its own; at the end, those of the tasks that counted get theirs.

    A scene's rows must come to one task (repartition by scene_id and sort within
    partitions); a scene of two tasks fails the write, and nothing is left.
    """

    def __init__(self, root: str, columns: list[str], overwrite: bool):
        self.root, self.columns, self.overwrite = root, columns, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, at = models.place(self.root)
        written: dict[str, str] = {}
        scene, out, n = None, None, 0
        try:
            for b in batches:
                for row in b.to_pylist():
                    if row["scene_id"] != scene:
                        if out:
                            out.write(b"\n]}\n")
                            out.close()
                        scene, n = row["scene_id"], 0
                        if str(scene) in written:
                            raise ValueError(f"rows of scene {scene} are apart: sort within partitions by scene_id")
                        written[str(scene)] = f"{at}/{scene}/.transforms-{uuid.uuid4().hex}"
                        where.create_dir(f"{at}/{scene}", recursive=True)
                        out = where.open_output_stream(written[str(scene)])
                        out.write(json.dumps({"camera_model": row.get("camera_model") or "OPENCV"})[:-1].encode() + b', "frames": [\n')
                    m = row["c2w"]
                    frame = {"file_path": row["file_path"], **{c: row[c] for c in NUMBERS if row.get(c) is not None}, "transform_matrix": [m[0:4], m[4:8], m[8:12], [0.0, 0.0, 0.0, 1.0]]}
                    out.write((b",\n" if n else b"") + json.dumps(frame).encode())
                    n += 1
            if out:
                out.write(b"\n]}\n")
        finally:
            if out and not out.closed:
                out.close()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        where, at = models.place(self.root)
        by_scene: dict[str, list[str]] = {}
        for m in messages:
            for scene, path in (m.files if m else {}).items():
                by_scene.setdefault(scene, []).append(path)
        twice = sorted(s for s, paths in by_scene.items() if len(paths) > 1)
        there = [] if self.overwrite else sorted(s for s in by_scene if where.get_file_info(f"{at}/{s}/transforms.json").type == fs.FileType.File)
        if twice or there:
            self.abort(messages)
            raise ValueError(f"scenes in several tasks, repartition by scene_id: {twice}" if twice else f"scenes that are there already, use overwrite: {there}")
        for scene, (path,) in by_scene.items():
            to = f"{at}/{scene}/transforms.json"
            if where.get_file_info(to).type == fs.FileType.File:
                where.delete_file(to)
            where.move(path, to)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = models.place(self.root)
        for m in messages:
            for path in (m.files if m else {}).values():
                if where.get_file_info(path).type == fs.FileType.File:
                    where.delete_file(path)


class ModelSource(CaptureSource):
    """``capture_model``: a table of binary structure-from-motion models, by the option ``table`` (cameras, images, observations or points).

    Where ``models.write_ranges`` has listed a file's ranges, they are dealt over partitions,
    neighbours together: at least ``SPREAD`` partitions of all files if they have as many
    ranges, and ``TASK`` bytes in one at most, but for a longer range.  Any other file is
    one, read range by range.
    """

    @classmethod
    def name(cls) -> str:
        return "capture_model"

    def table(self) -> str:
        table = self.options.get("table", "points")
        if table not in models.SCHEMAS:
            raise ValueError(f"capture_model: table is one of {', '.join(models.SCHEMAS)}, not {table}")
        return table

    def schema(self) -> str:
        return models.SCHEMAS[self.table()]

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.table(), scene_files(self.root(), models.FILES[self.table()], self.scenes()), schema)


class ModelReader(DataSourceReader):
    def __init__(self, table: str, files: list[tuple[str, int]], schema: StructType):
        self.table, self.files, self.schema = table, files, schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        most = min(TASK, sum(size for _, size in self.files) // SPREAD)
        for path, _ in self.files:
            cuts = models.planned(path)
            out += [Files([path])] if cuts is None else [Range(path, own) for own in _dealt(cuts, most)]
        return out or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        parts = [(partition.path, partition.cuts)] if isinstance(partition, Range) else [(p, [(s, e) for s, e, _ in models.ranges(p, self.table)]) for p in partition.paths]
        for path, cuts in parts:
            for start, end in models.joined(cuts):
                for rows in models.records(path, self.table, start, end):
                    yield pa.RecordBatch.from_pandas(rows[self.schema.fieldNames()], schema=to_arrow_schema(self.schema), preserve_index=False)


def _dealt(cuts: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Neighbouring ranges up to ``most`` bytes together, or one longer range."""
    out: list[list[tuple[int, int]]] = []
    for start, end, _ in cuts:
        if not out or end - out[-1][0][0] > most:
            out.append([])
        out[-1].append((start, end))
    return out


BUILT_IN: tuple[type[DataSource], ...] = (FramesSource, ModelSource)


def found() -> dict[str, type[DataSource]]:
    """Formats of other packages by name; what isn't a data source or can't be loaded is left out with a warning."""
    out: dict[str, type[DataSource]] = {}

    def add(name: str, load) -> None:
        try:
            made = load()
        except Exception as e:  # a faulty package must not keep the others out
            warnings.warn(f"format {name} can't be loaded: {e!r}", stacklevel=3)
            return
        if not (isinstance(made, type) and issubclass(made, DataSource)):
            warnings.warn(f"format {name} is {made!r}, not a class of DataSource", stacklevel=3)
        elif made.name() != name:
            warnings.warn(f"format {name} calls itself {made.name()}", stacklevel=3)
        else:
            out[name] = made

    for point in entry_points(group=GROUP):
        add(point.name, point.load)
    for part in filter(None, os.environ.get(VARIABLE, "").split(",")):
        name, _, target = part.strip().partition("=")
        module, _, attribute = target.partition(":")
        add(name, lambda module=module, attribute=attribute: getattr(importlib.import_module(module), attribute))
    return out


def register(spark: SparkSession) -> dict[str, type[DataSource]]:
    """Make our formats and those of other packages known to a session; a package's may replace one of ours."""
    every = {c.name(): c for c in BUILT_IN} | found()
    for source in every.values():
        spark.dataSource.register(source)
    return every
