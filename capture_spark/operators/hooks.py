"""Hooks: a user's function over Arrow batches of a table, with a schema that it has to keep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Hook = Callable[[pa.RecordBatch], "pa.RecordBatch | pa.Table"]


def checked(out: pa.RecordBatch | pa.Table, schema: pa.Schema, name: str) -> list[pa.RecordBatch]:
    """What a hook returned as batches of the schema; an error says what differs."""
    if not isinstance(out, (pa.RecordBatch, pa.Table)):
        raise TypeError(f"hook {name} returned {type(out).__name__}, not an Arrow batch or table")
    if out.schema.names != schema.names:
        raise ValueError(f"hook {name} returned the columns {out.schema.names}, not {schema.names}")
    for mine, wanted in zip(out.schema, schema, strict=True):
        if mine.type != wanted.type:
            raise ValueError(f"hook {name} returned {mine.name} as {mine.type}, not {wanted.type}")
    return out.to_batches() if isinstance(out, pa.Table) else [out]


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _name(hook: Hook) -> str:
    return getattr(hook, "__name__", type(hook).__name__)


def hooked(df: DataFrame, *hooks: tuple[Hook, StructType | str]) -> DataFrame:
    """The table after each hook in turn; a hook comes with the schema of what it returns.

    Hooks see one batch of rows at a time, in no order, and may return any number of
    rows; names and types are checked in each batch.  All of them run in one pass over
    the rows without a shuffle.  A table without rows calls none.
    """
    if not hooks:
        return df
    steps = [(hook, to_arrow_schema(_schema(schema)), _name(hook)) for hook, schema in hooks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def through(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
            if at == len(steps):
                yield batch
                return
            hook, schema, name = steps[at]
            for out in checked(hook(batch), schema, name):
                if out.num_rows:
                    yield from through(out, at + 1)

        for batch in batches:
            if batch.num_rows:
                yield from through(batch, 0)

    return df.mapInArrow(run, _schema(hooks[-1][1]))


def register_hook(spark: SparkSession, name: str, hook: Hook, schema: StructType | str) -> None:
    """Make a hook a table function of SQL: ``SELECT * FROM name(TABLE(rays) PARTITION BY scene_id)``; without a partition, rows come in any batches."""
    kept = _schema(schema)

    class Function:
        def __init__(self):
            self.schema = to_arrow_schema(kept)

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for out in checked(hook(batch), self.schema, name):
                yield pa.Table.from_batches([out])

    spark.udtf.register(name, arrow_udtf(Function, returnType=kept))
