"""Writers that put one whole file per scene, as tools of the format open it, by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(path: str):
    """A file to write at a path that executors share (file:, hdfs: and what else Arrow knows), with its folders made."""
    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    where.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(at)


def write_files(rows: DataFrame, path: str, name: str, parts: Callable[[str, Iterator], Iterator[bytes]], order: list[str]) -> None:
    """Write ``path``/<scene_id>/``name`` for each scene: what ``parts`` makes of the scene's rows, which come in order, batch by batch.

    A scene's file is one task's work, as it is one file; rows go to it as a
    stream, so memory is that of a batch.  A task that is run again writes its
    files anew.
    """
    columns = rows.columns

    def run(batches):
        def stream():
            for b in batches:
                yield from b.itertuples(index=False)

        found, held, n = stream(), None, 0
        row = next(found, None)
        while row is not None:
            scene = row[columns.index("scene_id")]

            def own():
                nonlocal held
                yield row
                for r in found:
                    if r[columns.index("scene_id")] != scene:
                        held = r
                        return
                    yield r

            held = None
            with opened(f"{path}/{scene}/{name}") as f:
                mine = own()
                for x in parts(scene, mine):
                    f.write(x)
                for _ in mine:
                    pass
            row, n = held, n + 1
        yield pd.DataFrame({"files": [n]})

    rows.repartition("scene_id").sortWithinPartitions("scene_id", *order).mapInPandas(run, "files long").agg(F.sum("files")).collect()
