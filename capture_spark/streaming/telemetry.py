"""Telemetry over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of telemetry rows from Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def exploded(events: DataFrame) -> DataFrame:
    """One row for each entry of ``values``, a map from name to number, of a run's event."""
    return events.select(F.col("user_id").alias("run_id"), "ts", "event_id", F.explode("values").alias("name", "value"))


def windowed_stats(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and means per run and name in tumbling windows, or sliding ones; rows later than ``late`` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "run_id", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "run_id", "name", "n", "mean")


def latest(events: DataFrame) -> DataFrame:
    """The value of the last event per run and name."""
    return events.groupBy("run_id", "name").agg(F.max_by("value", "event_id").alias("value"))


def run_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Spells of a run without a gap as long as ``gap``: events, last time, seconds from first to last."""
    s = events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return s.select("run_id", F.col("w.start").alias("start"), "n", "end", (F.col("end").cast("timestamp").cast("double") - F.col("w.start").cast("timestamp").cast("double")).alias("seconds"))


def deduplicated(events: DataFrame, late: str) -> DataFrame:
    """The first row of each event id among those no later than ``late``; how many were later is in the query's progress (``late_rows``)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def late_rows(query) -> int:
    """Rows that a running or ended query has dropped as too late."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def gated(events: DataFrame, every: int) -> DataFrame:
    """Events of every ``every``-th step."""
    return events.filter(F.col("step") % every == 0)


def voxel_max(hits: DataFrame) -> DataFrame:
    """The running largest level of each voxel."""
    return hits.groupBy("voxel_id").agg(F.max("level").alias("level"))


BUCKETS = 1024  # states of a moving average


def moving_average(events: DataFrame, n: int = 20) -> DataFrame:
    """Mean of the last ``n`` values per run and name, carried from batch to batch; a null counts as a row, not as a value.

    Runs and names are dealt into ``BUCKETS`` by their hash; a state has the last values of
    all of a bucket's series, which are averaged together.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])[["run_id", "name", "event_id", "value", "missing"]].astype({"run_id": "Int64", "name": object})
        old = 0
        if state.exists:
            runs, names, sizes, values, missing = state.get
            of = np.repeat(np.arange(len(sizes)), sizes)
            old = len(of)
            before = pd.DataFrame({"run_id": pd.array(runs, "Int64")[of], "name": np.array(names, object)[of], "event_id": 0, "value": np.array(values, float), "missing": np.array(missing, bool)})
            rows = pd.concat([before, rows], ignore_index=True)
        series = rows.groupby(["run_id", "name"], sort=False, dropna=False).ngroup().to_numpy()
        by = np.argsort(series, kind="stable")
        series, new = series[by], by >= old
        size = np.bincount(series)
        place = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size)
        missing = rows["missing"].to_numpy(bool)[by]
        values = rows["value"].to_numpy(float)[by]
        value, one = np.where(missing, 0.0, values), (~missing).astype(float)
        total, count = value.copy(), one.copy()
        for lag in range(1, min(n, int(size.max()))):
            own = place[lag:] >= lag
            total[lag:] += np.where(own, value[:-lag], 0.0)
            count[lag:] += np.where(own, one[:-lag], 0.0)
        last = np.repeat(size, size) - place <= n
        first = rows.iloc[by[place == 0]]
        state.update(([None if pd.isna(x) else int(x) for x in first["run_id"]], [None if pd.isna(x) else x for x in first["name"]], np.minimum(size, n).tolist(), values[last].tolist(), missing[last].tolist()))
        out = rows.iloc[by[new]]
        with np.errstate(invalid="ignore"):
            yield pd.DataFrame({"run_id": out["run_id"], "name": out["name"], "event_id": out["event_id"], "avg": total[new] / count[new]})

    dealt = events.select("run_id", "name", "ts", "event_id", F.col("value").cast("double").alias("value"), F.col("value").isNull().alias("missing"), F.pmod(F.xxhash64("run_id", "name"), F.lit(BUCKETS)).alias("bucket"))
    kept = "runs array<long>, names array<string>, sizes array<long>, values array<double>, missing array<boolean>"
    return dealt.groupBy("bucket").applyInPandasWithState(step, "run_id long, name string, event_id long, avg double", kept, "append", "NoTimeout")


def drain(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
