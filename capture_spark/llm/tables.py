"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings while a table is written: shuffle files go with their query; batches of long texts to Python workers stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: Where the tables lie that the operator in ``settled`` has stored.
_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs its own tasks only.  The shuffle
    files of the write are of no more use then, and go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if (paths := _paths.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Store what ``make`` returns, then delete the tables that it stored on the way.

    If it fails, they stay with the shared folder, as its failed jobs' files do.
    """
    mine: list[str] = []
    token = _paths.set(mine)
    try:
        made = make()
    finally:
        _paths.reset(token)
    out = stored(made, name)
    for path in mine:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark broadcasts only what it has measured in a shuffle or is told to, not what it takes to be small.

    Its guess goes by the size of files and by types: an array counts as one
    element, so that a table exploded from packed columns looks far too small.
    """
    guess, known = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (guess, known)}
    try:
        spark.conf.set(known, before[known] or spark.conf.get(guess))
        spark.conf.set(guess, "-1")
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``position``: the place of each row within its group, from 0, gapless.

    The rows are dealt by range over (group, order), so that one large group
    spreads over many tasks, and written once.  Each task counts its own rows
    of a group, as run lengths of the sorted keys; the counts of the tasks before
    it are added by a join.  A column named position is replaced.
    """
    df = df.drop("position")
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    part_name, row_name = fresh("range_part", df), fresh("range_row", df)
    schema = df.schema
    out_schema = df.withColumns({part_name: F.lit(0), row_name: F.lit(0).cast("long")}).schema
    group_at = [schema.fieldNames().index(c) for c in group]

    def number(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for i in group_at:
                codes = b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = True
            starts = np.flatnonzero(new)
            rows = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            first, end = (tuple(b.column(i)[k].as_py() for i in group_at) for k in (0, b.num_rows - 1))
            if first == last:
                rows[: starts[1] if len(starts) > 1 else b.num_rows] += seen
            last, seen = end, int(rows[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(rows, pa.int64())], names=[*b.schema.names, part_name, row_name])

    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(dealt.mapInArrow(number, out_schema), name)
    of = {c: fresh(f"start_{c}", ranged) for c in [*group, part_name]}
    start = fresh("part_start", ranged)
    counts = ranged.groupBy(*group, part_name).agg(F.count("*").alias(start))
    before = Window.partitionBy(*group).orderBy(part_name).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(to) for c, to in of.items()], F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    same = F.lit(True)
    for c, to in of.items():
        same = same & F.col(c).eqNullSafe(F.col(to))
    return ranged.join(starts, same, "left").withColumn("position", F.col(start) + F.col(row_name)).select(*df.columns, "position")
