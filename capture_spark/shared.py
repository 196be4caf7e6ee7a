"""Tables in the session's shared folder, for steps that would else grow the lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator, in a folder of its own that goes when the operator's result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


def numbered(scratch: Scratch, df: DataFrame, order: list[str], name: str, part_rows: int | None = None) -> DataFrame:
    """Add ``name``: each row's place in order, from 0, without a task that has them all.

    With ``part_rows``, tasks have about so many rows, however few bytes those take; ``df`` is then counted.

    Rows are dealt by range and sorted within tasks, and written with their task and
    their place in it; the numbers of rows of the tasks before are then added.
    """
    part, row, before = (f"{name}_{x}" for x in ("part", "row", "before"))
    parts = [] if part_rows is None else [df.count() // part_rows + 1]
    dealt = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    table = scratch.written(dealt.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    tasks = table.groupBy(part).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    sums = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    tasks = tasks.select(part, (F.coalesce(sums, F.lit(0)) - F.col("first")).alias(before))
    return table.join(F.broadcast(tasks), part).withColumn(name, F.col(row) + F.col(before)).drop(part, row, before)


def settled(spark: SparkSession, name: str, make: Callable[[Scratch], DataFrame]) -> DataFrame:
    """Write what ``make`` returns and read it back; what it wrote on the way is deleted."""
    scratch = Scratch(spark)
    made = make(scratch)
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    made.write.parquet(path)
    delete(spark, scratch.path)
    return spark.read.schema(made.schema).parquet(path)
