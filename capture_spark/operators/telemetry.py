"""Run telemetry in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_avg(telemetry: DataFrame, n: int = 20, steps: int | None = None) -> DataFrame:
    """Mean of the last n values per run and name; with the run's number of steps, also what is left at that mean."""
    by = Window.partitionBy("run_id", "name").orderBy("step").rowsBetween(-(n - 1), 0)
    out = telemetry.select("run_id", "name", "step", F.avg("value").over(by).alias("avg"))
    return out if steps is None else out.withColumn("eta", F.greatest(F.lit(steps) - F.col("step"), F.lit(0)) * F.col("avg"))


def latest_stats(telemetry: DataFrame, every: int, steps: int) -> DataFrame:
    """At each logging step of a run: the latest value of each name so far, and the share of steps done.

    Logging steps are multiples of ``every`` that the run has reached in any name.
    """
    at = telemetry.select("run_id", (F.floor(F.col("step") / every) * every).alias("at")).distinct()
    names = telemetry.select("run_id", "name").distinct()
    marks = at.join(names, "run_id").select("run_id", "name", F.col("at").alias("step"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("mark"))
    rows = telemetry.select("run_id", "name", "step", "value", F.lit(0).alias("mark")).unionByName(marks)
    by = Window.partitionBy("run_id", "name").orderBy("step", "mark").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("value", F.last("value", ignorenulls=True).over(by)).filter("mark = 1 AND value IS NOT NULL")
    return out.select("run_id", "name", "step", "value", F.least(F.col("step") / float(steps), F.lit(1.0)).alias("done"))


def eval_report(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("run_id", "name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))


def render_rates(images: DataFrame) -> DataFrame:
    """Per run: rays and images per second, as means over images of (width, height, seconds) and their deviation; images that took no time don't count."""
    rays, fps = F.try_divide(F.col("width") * F.col("height"), F.col("seconds")), F.try_divide(F.lit(1.0), F.col("seconds"))
    return images.groupBy("run_id").agg(F.avg(rays).alias("rays_per_second"), F.stddev_samp(rays).alias("rays_std"), F.avg(fps).alias("fps"), F.stddev_samp(fps).alias("fps_std"))


def profile(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("name").agg(F.avg("value").alias("mean"), F.count("*").alias("calls"))


def dynamic_budget(log: DataFrame, target: float, start: int, most: int = 1 << 31) -> DataFrame:
    """(run_id, size): batch sizes by feedback, each step multiplying the size by target over observed, in whole numbers from 1 to ``most``.

    A run's rows pass one by one in order of event_id, and its size alone is carried
    on, so a run of any length is one stream.  An observed value under 1 counts as 1; a
    step without a number leaves the size.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, size, done = None, start, []
        for b in batches:
            for of, value in zip(b["run_id"].tolist(), b["value"].tolist(), strict=True):
                if of != run:
                    if run is not None:
                        done.append((run, size))
                    run, size = of, start
                if value is not None and value == value:
                    size = int(min(max(size * target / max(value, 1.0) // 1, 1), most))
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=["run_id", "size"])
                done = []
        if run is not None:
            done.append((run, size))
        yield pd.DataFrame(done, columns=["run_id", "size"])

    rows = log.select("run_id", "event_id", F.col("value").cast("double").alias("value")).filter("run_id IS NOT NULL")
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "event_id").select("run_id", "value")
    return ordered.mapInPandas(fold, f"run_id {dict(log.dtypes)['run_id']}, size long")
