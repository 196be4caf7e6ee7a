"""Steps that were rebuilt for larger inputs in round 3, on small inputs that reach their edges."""

import random

import numpy as np

from capture_spark.operators import pixels, points, trees
from capture_spark.streaming import telemetry as live
from test_scale import VIEW, flat, turned


def test_voxel_hits_do_not_depend_on_parts(spark, monkeypatch):
    r = random.Random(7)
    views = [(0, i, flat(turned(r), [r.uniform(-2, 2) for _ in range(3)]), 10.0, 10.0, 6.0, 4.5) for i in range(9)]
    depth = [(0, i, x, y, r.uniform(0.5, 4), None if x == 3 else float(x)) for i in range(9) for x in range(12) for y in range(9)]
    depth += depth[:1] + [(0, 1, None, 2, 1.0, 0.5)]
    voxels = [(0, k, *[r.uniform(-4, 4) for _ in range(3)]) for k in range(700)] + [(0, 900, float("nan"), 0.0, 0.0), (0, 901, None, 0.0, 0.0), (1, 5, 0.0, 0.0, 0.0)]
    v = spark.createDataFrame(views, VIEW)
    d = spark.createDataFrame(depth, "scene_id long, image_id long, px long, py long, depth double, r double")
    c = spark.createDataFrame(voxels, "scene_id long, voxel_id long, x double, y double, z double")
    whole = sorted(points.voxel_hits(c, v, d, 0.5).collect(), key=str)
    monkeypatch.setattr(points, "VOXELS", 100)
    monkeypatch.setattr(points, "VIEWS", 2)
    parts = sorted(points.voxel_hits(c, v, d, 0.5).collect(), key=str)
    assert whole == parts and len(whole) > 20 and any(x["r"] is None for x in whole)


def test_walk_takes_rows_of_one_place_together(monkeypatch):
    r = np.random.default_rng(2)
    places = r.integers(-3, 3, (400, 3)).astype(float)
    left, at, want = set(range(1, 400)), 0, [0]
    while left:
        at = min(left, key=lambda k: (((places[k] - places[at]) ** 2).sum(), k))
        left.remove(at)
        want.append(at)
    steps = []
    monkeypatch.setattr(trees.Leaves, "bounds", lambda self, place, found=trees.Leaves.bounds: steps.append(1) or found(self, place))
    assert trees.nearest_walk(places).tolist() == want
    assert len(steps) < len(np.unique(places, axis=0))


def test_moving_average_of_many_series_in_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 2)
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3]), r.choice(["a", "b", None]), k, r.choice([None, r.uniform(-1, 1), r.uniform(-1, 1)])) for k in range(300)]
    for k in range(3):
        part = rows[100 * k : 100 * k + 100]
        spark.createDataFrame(part, "run_id long, name string, event_id long, value double").selectExpr("*", "timestamp_seconds(event_id) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.ingest(spark, f"{tmp_path}/in", "run_id long, name string, event_id long, value double, ts timestamp", 1)
    live.drain(live.moving_average(stream, 4), "append", f"{tmp_path}/log", lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"))
    want, seen = {}, {}
    for run, name, k, value in rows:
        last = seen.setdefault((run, name), [])
        last.append(value)
        real = [x for x in last[-4:] if x is not None]
        want[run, name, k] = sum(reversed(real)) / len(real) if real else None
    got = {(x["run_id"], x["name"], x["event_id"]): x["avg"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == want.keys() and any(x is None for x in want.values())
    assert all(got[k] is x is None or abs(got[k] - x) < 1e-12 for k, x in want.items())


def test_color_correct_of_images_in_many_batches(spark):
    r = random.Random(5)
    rows = [(s, i, y, x, *[r.random() for _ in range(6)]) for s, i in ((0, 0), (0, 1), (1, 0), (None, 0)) for y in range(8) for x in range(8)]
    r.shuffle(rows)
    rows.append((1, 0, 9, 9, float("nan"), 0.5, 0.5, 0.5, 0.5, 0.5))
    p = spark.createDataFrame(rows, "scene_id long, image_id long, y long, x long, r double, g double, b double, ref_r double, ref_g double, ref_b double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    results = []
    try:
        for size in ("3", "10000"):
            spark.conf.set(key, size)
            results.append({(x["scene_id"], x["image_id"], x["y"], x["x"]): x for x in pixels.color_correct(p, 2).collect()})
    finally:
        spark.conf.set(key, before)
    few, many = results
    assert few.keys() == many.keys() and len(few) == 193
    assert all(abs(few[k][c] - many[k][c]) < 1e-6 for k in few if k[2] < 9 for c in "rgb")
