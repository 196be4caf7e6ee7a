"""Hooks, orders of cameras in k-d leaves, and rows that once divided by 0."""

import math
import random
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark import cloudpickle

from capture_spark.operators import hooks, listings, pixels, points, rays, scenes, telemetry, trees

@pytest.fixture(autouse=True, scope="module")
def by_value():
    """Workers don't have this module, as they may not have a user's notebook."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


RAYS = "scene_id long, ray_id long, ox double, dx double"


def doubled(batch):
    return pa.RecordBatch.from_arrays([batch.column("ray_id"), pc.multiply(batch.column("dx"), 2.0)], names=["ray_id", "twice"])


def positive(batch):
    return batch.filter(pc.greater(batch.column("twice"), 0))


def test_hooks_in_turn(spark):
    rays = spark.createDataFrame([(0, k, 0.0, float(k - 5)) for k in range(10)], RAYS).repartition(3)
    schema = "ray_id long, twice double"
    got = hooks.hooked(rays, (doubled, schema), (positive, schema))
    assert sorted(map(tuple, got.collect())) == [(k, 2.0 * (k - 5)) for k in range(6, 10)]
    assert hooks.hooked(rays) is rays and hooks.hooked(rays.limit(0), (doubled, schema)).collect() == []


@pytest.mark.parametrize(("made", "says"), [(lambda b: b, "returned the columns"), (lambda b: b.select(["ray_id"]).rename_columns(["n"]), "returned the columns"), (lambda b: 3, "returned int"), (lambda b: pa.table({"ray_id": pc.cast(b.column("ray_id"), pa.int32())}), "ray_id as int32, not int64")])
def test_hooks_keep_their_schema(spark, made, says):
    rays = spark.createDataFrame([(0, 1, 0.0, 1.0)], RAYS)
    with pytest.raises(Exception, match=says):
        hooks.hooked(rays, (made, "ray_id long")).collect()


def test_hooks_in_sql(spark):
    spark.createDataFrame([(k % 2, k, 0.0, float(k)) for k in range(10)], RAYS).createOrReplaceTempView("hook_rays")
    hooks.register_hook(spark, "doubled_rays", doubled, "ray_id long, twice double")
    got = spark.sql("SELECT * FROM doubled_rays(TABLE(hook_rays))").collect()
    assert sorted(map(tuple, got)) == [(k, 2.0 * k) for k in range(10)]


def test_walks_by_all_pairs():
    r = np.random.default_rng(4)
    for n, kinds in ((1, 9), (2, 9), (40, 2), (700, 6), (700, 10**6)):
        p = r.integers(0, kinds, (n, 3)).astype(float)
        left, at, want = np.ones(n, bool), 0, []
        for _ in range(n):
            want.append(at)
            left[at] = False
            at = int(np.where(left, ((p - p[at]) ** 2).sum(1), np.inf).argmin())
        assert trees.nearest_walk(p).tolist() == want
        near, at, want = np.full(n, np.inf), 0, []
        for _ in range(n):
            want.append(at)
            near = np.minimum(near, ((p - p[at]) ** 2).sum(1))
            near[want] = -1.0
            at = int(near.argmax())
        assert trees.farthest_walk(p, n + 5).tolist() == want and trees.farthest_walk(p, 3).tolist() == want[:3]
    assert trees.nearest_walk(np.zeros((0, 3))).tolist() == [] == trees.farthest_walk(np.zeros((0, 4)), 3).tolist()


def test_walks_of_many_cameras():
    p = np.random.default_rng(1).normal(size=(100_000, 3))
    start = time.process_time()
    assert len(set(trees.nearest_walk(p[:20_000]).tolist())) == 20_000
    assert len(set(trees.farthest_walk(p, 500).tolist())) == 500
    assert time.process_time() - start < 60


def test_orders_with_faulty_centres(spark):
    frames = [(0, k, *c, k % 3) for k, c in enumerate([(0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0), (5.0, 0.0, 0.0), (1.0, 0.0, 0.0), (float("inf"), 0.0, 0.0)])]
    df = spark.createDataFrame(frames, "scene_id long, frame_id long, tx double, ty double, tz double, unsampled long")
    assert [r["frame_id"] for r in scenes.order_poses(df).orderBy("place").collect()] == [0, 3, 2, 1, 4]
    assert [r["frame_id"] for r in scenes.farthest_first(df, 9).orderBy("place").collect()] == [0, 2, 3]


def test_scenes_of_one_place(spark):
    rows = [(s, k, f"{k}.png", 0.3, 0.1, x, 2.0, 3.0) for s, k, x in ((0, 0, 1.0), (1, 0, 4.0), (1, 1, 4.0), (2, 0, 0.0), (2, 1, 2.0))]
    df = spark.createDataFrame(rows, "scene_id long, frame_id long, file_path string, yaw double, pitch double, tx double, ty double, tz double")
    got = scenes.normalised(df).collect()
    assert len(got) == 5
    for r in got:
        size = max(abs(r[f"n{c}"]) for c in "xyz")
        assert (r["scale"], size) == (1.0, 0.0) if r["scene_id"] < 2 else math.isclose(size, 1.0)


def test_no_row_divides_by_zero(spark):
    cloud = spark.createDataFrame([(0, k, float(k), 2.0, None if k else 1.0) for k in range(3)], "scene_id long, point3d_id long, x double, y double, z double")
    got = {r["point3d_id"]: (r["x"], r["y"], r["z"]) for r in points.normalise_to_box(cloud).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 1: (0.5, 0.0, None), 2: (1.0, 0.0, None)}
    px = spark.createDataFrame([(0, 0, 0, 0, 0.5, 0.5, 0.5), (0, 0, 0, 1, 1.0, 0.5, 0.5)], "scene_id long, image_id long, y long, x long, n0 double, n1 double, n2 double")
    ims = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "scene_id long, image_id long, c2w array<double>")
    assert sorted((r["x"], r["w0"], r["w1"], r["w2"]) for r in pixels.normals_to_world(px, ims).collect()) == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)]
    matched = spark.createDataFrame([(1, 0, 0), (2, 4, 4), (3, 1, 4)], "scene_id long, matched long, initial long")
    assert sorted((r["scene_id"], r["ratio"], r["grade"]) for r in listings.match_summary(matched).collect()) == [(1, None, None), (2, 1.0, "all"), (3, 0.25, "few")]
    splats = spark.createDataFrame([(0, 0.0, 1.0, 2.0), (1, 1.0, 1.0, 2.0)], "scene_id long, s0 double, s1 double, s2 double")
    assert sorted(map(tuple, listings.splat_shape(splats, 10.0).collect())) == [(0, float("inf"), 1), (1, 0.0, 0)]
    shown = spark.createDataFrame([(1, 10, 10, 0.0), (1, 10, 10, 2.0)], "run_id long, width long, height long, seconds double")
    assert [(r["rays_per_second"], r["fps"]) for r in telemetry.render_rates(shown).collect()] == [(50.0, 0.5)]


def test_nearest_in_scenes_of_unlike_density(spark):
    r = random.Random(9)
    rows = [(0, k, *[r.gauss(0, 1e-3) for _ in range(3)]) for k in range(400)] + [(0, 1000 + k, *[r.uniform(-100, 100) for _ in range(3)]) for k in range(30)]
    rows += [(1, k, float(k), 0.0, 0.0) for k in range(5)] + [(2, 0, 1.0, 1.0, 1.0), (3, 0, 2.0, 2.0, 2.0), (3, 1, 2.0, 2.0, 2.0), (3, 2, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scene_id long, point3d_id long, x double, y double, z double")
    want = {}
    for s, k, *p in rows:
        others = sorted((math.dist(p, q), j) for s2, j, *q in rows if s2 == s and j != k and None not in q) if None not in p else []
        want |= {(s, k, n + 1): j for n, (_, j) in enumerate(others[:4])}
    got = {(x["scene_id"], x["point3d_id"], x["rank"]): x["other_id"] for x in points.nearest(df, 4).collect()}
    assert got == want


CAMERA = "scene_id long, camera_id long, fx double, fy double, cx double, cy double"
POSED = "scene_id long, frame_id long, camera_id long, c2w array<double>"
UPRIGHT = [1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 6.0, 0.0, 0.0, 1.0, 7.0]


def test_spiral_poses(spark):
    """Against cross products in NumPy; up along the line of sight keeps the right axis; scenes without a known camera have no path."""
    cameras = spark.createDataFrame([(0, 1, 300.0, 200.0, 4.0, 5.0), (1, 1, 9.0, 9.0, 1.0, 1.0)], CAMERA)
    tilted = [0.0, -1.0, 0.0, 1.0, 0.6, 0.0, 0.8, 2.0, -0.8, 0.0, 0.6, 3.0]
    frames = spark.createDataFrame([(0, 3, 1, tilted), (0, 8, 1, UPRIGHT), (1, 0, 1, UPRIGHT), (2, 0, 1, UPRIGHT)], POSED)
    got = {(r["scene_id"], r["step"]): r for r in scenes.spiral_poses(frames, cameras, 5, (0.5, 0.4, 0.3), 2.0, 0.5).collect()}
    assert len(got) == 10 and {s for s, _ in got} == {0, 1}
    base = np.vstack([np.array(tilted).reshape(3, 4), [0, 0, 0, 1]])
    for k in range(5):
        a = 2 * math.pi * 2 * k / 5
        centre = np.array([0.5 * math.cos(a), -0.4 * math.sin(a), -0.3 * math.sin(a / 2)])
        back = centre + [0, 0, 200.0]
        back /= np.linalg.norm(back)
        right = np.cross(base[:3, 2], back)
        right /= np.linalg.norm(right)
        local = np.vstack([np.stack([right, np.cross(back, right), back, centre], 1), [0, 0, 0, 1]])
        r = got[0, k]
        assert np.allclose(np.array(r["c2w"]).reshape(3, 4), (base @ local)[:3]) and r["fx"] == 300 and r["time"] == k / 4
        axes = np.array(r["c2w"]).reshape(3, 4)[:, :3]
        assert np.allclose(axes.T @ axes, np.eye(3))
    still = scenes.spiral_poses(frames, cameras, 1, (0.0, 0.0, 0.0), 1.0, 0.5).collect()
    assert len(still) == 2 and all(None not in r["c2w"] and r["time"] == 0 for r in still)
    assert scenes.spiral_poses(frames.limit(0), cameras, 5, (1.0, 1.0, 1.0), 2.0, 0.5).collect() == []


def test_given_boxes(spark):
    boxes = spark.createDataFrame([(0, 0.0, 1.0, 2.0, 4.0, 1.0, 6.0)], "scene_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    cloud = spark.createDataFrame([(0, 1.0, 3.0, 7.0), (1, 0.0, 0.0, 0.0)], "scene_id long, x double, y double, z double")
    assert list(map(tuple, points.normalise_to_box(cloud, boxes).collect())) == [(0, 0.25, 2.0, 1.25)]
    assert tuple(scenes.recentred_box(boxes, 2.0).first()) == (0, -4.0, 0.0, -4.0, 4.0, 0.0, 4.0)


def test_colours_and_depths_there_and_back(spark):
    some = spark.createDataFrame([(k, 255 - k, k // 2) for k in range(256)], "r int, g int, b int")
    back = points.splat_rgb(points.splat_colors(some).withColumnsRenamed({c: f"old_{c}" for c in "rgb"})).collect()
    assert len(back) == 256 and all((r["r"], r["g"], r["b"]) == (r["old_r"], r["old_g"], r["old_b"]) and abs(r["alpha"] - 0.1) < 1e-12 for r in back)
    loud = spark.createDataFrame([(9.0, -9.0, 0.0, 0.0)], "f_dc_0 double, f_dc_1 double, f_dc_2 double, opacity double")
    assert tuple(points.splat_rgb(loud).select("r", "g", "b", "alpha").first()) == (255, 0, 128, 0.5)
    cameras = spark.createDataFrame([(0, 0, 3.0, 4.0, 2.0, 2.0)], CAMERA)
    pixels_ = spark.createDataFrame([(0, 0, 0, y, x, 1.0 + x + y) for y in range(4) for x in range(4)], "scene_id long, image_id long, camera_id long, y long, x long, depth_gt double")
    far = rays.depth_to_distance(pixels_, cameras).select(*pixels_.columns, "distance")
    near = rays.distance_to_depth(far, cameras).collect()
    assert len(near) == 16 and all(abs(r["depth"] - r["depth_gt"]) < 1e-12 and r["distance"] > r["depth"] for r in near)


def test_blended_depth(spark):
    some = spark.createDataFrame([(0, 0, 0, k, d, a) for k, (d, a) in enumerate([(0.0, 1.0), (4.0, 0.5), (99.0, 0.0), (None, 1.0)])], "scene_id long, image_id long, y long, x long, depth_pred double, acc double")
    got = [r["value"] for r in pixels.normalise_depth(some, 2.0, 6.0, "acc").orderBy("x").collect()]
    assert got[0] == 0 and abs(got[1] - 0.75) < 1e-9 and got[2] == 1


def test_merged_bins(spark):
    """Intervals of a ray meet end to end, keep its edges, and are one more for each new place."""
    some = spark.createDataFrame([(0, r, k, k * 0.5, 0.5, float(r * (k == 2))) for r in range(3) for k in range(4)], "scene_id long, ray_id long, sample_idx long, t_start double, delta double, density double")
    by_ray = {}
    for r in rays.merged_bins(some, 5).orderBy("ray_id", "sample_idx").collect():
        by_ray.setdefault(r["ray_id"], []).append((r["sample_idx"], r["t_start"], r["t_end"]))
    for r, cut in by_ray.items():
        assert [k for k, _, _ in cut] == list(range(9)) and cut[0][1] == 0 and cut[-1][2] == 2
        assert all(a[2] == b[1] for a, b in zip(cut, cut[1:])) and {0, 0.5, 1.0, 1.5} <= {a for _, a, _ in cut}
    assert sum(1 <= a < 1.5 for _, a, _ in by_ray[2]) > sum(1 <= a < 1.5 for _, a, _ in by_ray[0])
    assert len(by_ray) == 3 and rays.merged_bins(some.limit(0), 5).collect() == []
