"""Operators that were rebuilt for large scenes, against plain Python over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_spark import shared
from capture_spark.operators import cameras, joins, pixels, points, rays, sampling, telemetry


def turned(r):
    """A random camera to world rotation."""
    q, _ = np.linalg.qr(np.array([[r.gauss(0, 1) for _ in range(3)] for _ in range(3)]))
    return q * np.sign(np.linalg.det(q))


def flat(m, t):
    return [float(x) for row, c in zip(m, t, strict=True) for x in (*row, c)]


VIEW = "scene_id long, image_id long, c2w array<double>, fx double, fy double, cx double, cy double"


@pytest.mark.parametrize(("cell", "side", "behind"), [(0.7, 3, True), (3.0, 8, False)])
def test_voxel_hits_by_all_pairs(spark, cell, side, behind):
    r = random.Random(4)
    views = [(s, i, turned(r), [r.uniform(-2, 2) for _ in range(3)]) for s in range(2) for i in range(4)]
    depth = {(s, i, x, y): r.choice([0.0, r.uniform(0.5, 4)]) for s, i, *_ in views for x in range(12) for y in range(9)}
    voxels = [(s, k, *[r.uniform(-4, 4) for _ in range(3)]) for s in range(2) for k in range(1000)]
    voxels += [(s, 2000 + i, *[float(x) for x in t]) for s, i, _, t in views]  # at the camera itself
    want = {}
    for s, i, m, t in views:
        for s2, k, *p in voxels:
            d = np.array(p) - t
            x, y, z = m.T @ d
            if s2 != s or abs(z) <= 1e-9 or (not behind and z > 0):
                continue
            px, py = math.floor(10 * x / -z + 6), math.floor(10 * -y / -z + 4.5)
            seen, far = depth.get((s, i, px, py), 0), float(np.linalg.norm(d))
            if seen > 0 and seen - far > -0.5:
                want[s, k, i] = max(min((seen - far) / 0.5, 1), -1)
    v = spark.createDataFrame([(s, i, flat(m, t), 10.0, 10.0, 6.0, 4.5) for s, i, m, t in views], VIEW)
    d = spark.createDataFrame([(*k, x, 0.5) for k, x in depth.items()], "scene_id long, image_id long, px long, py long, depth double, r double")
    c = spark.createDataFrame(voxels, "scene_id long, voxel_id long, x double, y double, z double")
    hits = points.voxel_hits(c, v, d, 0.5, cell, side, behind)
    got = {(x["scene_id"], x["voxel_id"], x["view_order"]): x["tsdf"] for x in hits.collect()}
    assert got.keys() == want.keys() and len(want) > 15 and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    grid = {(x["scene_id"], x["voxel_id"]): x for x in points.fused_grid(c, hits).collect()}
    assert len(grid) == len(voxels)
    untouched = [x for k, x in grid.items() if not any((*k, i) in want for i in range(4))]
    assert untouched and all((x["value"], x["n"], x["r"]) == (-1.0, 0, 0.0) for x in untouched)


BOX = "scene_id long, sample_id long, box_id long, bx double, by double, bz double, sx double, sy double, sz double, yaw double"
IMAGE = VIEW + ", sample_id long, width int, height int"


def hull_pixels(corners, w, h):
    """Pixels in the hull of whole-pixel corners, by half planes of its edges."""
    p = sorted(set(corners))
    out = set()
    for x in range(w):
        for y in range(h):
            if len(p) == 1:
                inside = p[0] == (x, y)
            else:
                inside = True
                for i, a in enumerate(p):
                    for b in p[i + 1 :]:
                        side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in p]
                        mine = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
                        if all(v >= 0 for v in side):
                            inside &= mine >= 0
                        if all(v <= 0 for v in side):
                            inside &= mine <= 0
                if all(v == 0 for v in side):  # all on a line
                    inside &= min(c[0] for c in p) <= x <= max(c[0] for c in p) and min(c[1] for c in p) <= y <= max(c[1] for c in p)
            if inside:
                out.add((x, y))
    return out


def test_box_spans_are_hulls(spark):
    r = random.Random(8)
    boxes, images, want = [], [], {}
    for k in range(40):
        m, t = turned(r), [0.0, 0.0, 0.0]
        centre = -m[:, 2] * r.uniform(3, 8) + m[:, 0] * r.uniform(-2, 2) + m[:, 1] * r.uniform(-2, 2)
        size, yaw = [r.uniform(0.2, 2) for _ in range(3)], r.uniform(-3, 3)
        boxes.append((0, k, k, *[float(x) for x in centre], *size, yaw))
        images.append((0, k, flat(m, t), 20.0, 22.0, 16.0, 12.0, k, 32, 24))
        corners = []
        for a in (-0.5, 0.5):
            for b in (-0.5, 0.5):
                for c in (-0.5, 0.5):
                    dx, dy = a * size[0], b * size[1]
                    w = centre + [math.cos(yaw) * dx - math.sin(yaw) * dy, math.sin(yaw) * dx + math.cos(yaw) * dy, c * size[2]]
                    x, y, z = m.T @ w
                    corners.append((round(20 * x / -z + 16), round(12 - 22 * y / -z)))
        want[k] = hull_pixels(corners, 32, 24)
    got = {k: set() for k in want}
    ims = spark.createDataFrame(images, IMAGE)
    for s in joins.box_spans(spark.createDataFrame(boxes, BOX), ims).collect():
        got[s["box_id"]] |= {(x, s["y"]) for x in range(s["x0"], s["x1"] + 1)}
    assert got == want and sum(map(len, want.values())) > 500
    strips = joins.box_spans(spark.createDataFrame([], BOX), ims.withColumn("ego_rows", F.when(F.col("image_id") == 3, 30).otherwise(0)))
    assert {(s["image_id"], s["box_id"], s["x0"], s["x1"]) for s in strips.collect()} == {(3, None, 0, 31)} and strips.count() == 24


def test_boxes_through_the_camera_plane(spark):
    image = spark.createDataFrame([(0, 0, flat(np.eye(3), [0.0, 0.0, 0.0]), 10.0, 10.0, 20.0, 20.0, 0, 40, 40)], IMAGE)
    boxes = [(0, 0, 1, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (0, 0, 2, 0.0, 0.0, 5.0, 1.0, 1.0, 1.0, 0.0), (0, 0, 3, 1.0, 0.0, -1.0, 1.0, 1.0, 2.0, 0.0), (0, 0, 4, 0.0, 0.0, -2.0, 1.0, 1.0, 2.0 - 1e-300, 0.0)]
    got = {x["box_id"]: x for x in joins.project_boxes(spark.createDataFrame(boxes, BOX), image).collect()}
    assert set(got) == {1, 3, 4}  # 2 is wholly behind; 1 holds the camera; 3 has corners at depth 0
    assert [got[1][c] for c in ("x0", "y0", "x1", "y1")] == [0, 0, 40, 40]
    assert math.isclose(got[3]["x0"], 22.5) and got[3]["x1"] == 40
    masks = joins.span_masks(spark.createDataFrame([(0, 0, y, x) for y in range(40) for x in range(40)], "scene_id long, image_id long, y long, x long"), joins.box_spans(spark.createDataFrame(boxes[2:3], BOX), image))
    assert {r["keep"] for r in masks.filter("x < 22").collect()} == {True} and masks.filter("y = 20 AND x > 23 AND keep").count() == 0


def test_interval_envelope_by_all_pairs(spark):
    r = random.Random(3)
    row = lambda ray, k: (0, ray, k, r.randint(0, 12) / 2, r.choice([0.0, 0.5, 1.0, 2.5]), r.random())
    t, e = [[row(ray, k) for ray in range(20) for k in range(8)] for _ in range(2)]
    kind = "scene_id long, ray_id long, sample_idx long, t_start double, delta double, weight double"
    want = {}
    for _, ray, k, s, d, _ in t:
        met = [w for _, ray2, _, s2, d2, w in e if ray == ray2 and d > 0 and d2 > 0 and s2 < s + d and s2 + d2 > s]
        if met:
            want[ray, k] = sum(met)
    got = {(x["ray_id"], x["sample_idx"]): x["bound"] for x in rays.interval_envelope(spark.createDataFrame(t, kind), spark.createDataFrame(e, kind)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_numbers_without_one_task(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)

    def make(scratch):
        return shared.numbered(scratch, df, ["k"], "at")

    got = shared.settled(spark, "numbers", make).collect()
    assert len(got) == 1000 and all(r["k"] == r["at"] for r in got)


def test_discs_lose_no_draw(spark):
    ims = spark.createDataFrame([(0, 0, 3, 200), (0, 1, 1, 1), (0, 2, 50, 50)], "scene_id long, image_id long, width long, height long")
    for radius in (0.0, 0.4, 10.0, 1e6):
        d = sampling.sample_disc(spark, ims, 3000, radius, 3).toPandas()
        assert len(d) == 3000 and (d["x"] >= 0).all() and (d["y"] >= 0).all()
        assert (d[d["image_id"] == 0]["x"] <= 2).all() and (d[d["image_id"] == 2]["x"] < 50).all()
    wide = d[d["image_id"] == 2]
    assert abs(wide["x"].mean() - 24.5) < 2 and wide["y"].max() == 49 and wide["y"].min() == 0


def test_patches_in_a_mask(spark):
    r = random.Random(1)
    mask = {(y, x): r.random() < 0.85 for y in range(20) for x in range(16)}
    px = spark.createDataFrame([(0, 0, y, x, m) for (y, x), m in mask.items()], "scene_id long, image_id long, y long, x long, mask boolean")
    whole = {(y, x) for y in range(18) for x in range(14) if all(mask[y + a, x + b] for a in range(3) for b in range(3))}
    got = sampling.sample_masked_patches(px, 9 * 1000, 3, 1).toPandas()
    corners = got.groupby("draw")[["y", "x"]].min()
    assert set(map(tuple, corners.to_numpy().tolist())) == whole and len(got) == 9 * len(whole)
    few = sampling.sample_masked_patches(px, 9 * 4 + 5, 3, 1)
    assert few.count() == 36 and all(mask[p["y"], p["x"]] for p in few.collect())


def test_budget_by_feedback(spark):
    log = [(1, 2, 500.0), (1, 1, 125.0), (1, 3, None), (2, 1, float("nan")), (3, 1, 0.0), (3, 2, 0.0), (3, 3, 0.0), (3, 4, 1e9), (None, 1, 2.0)]
    got = {r["run_id"]: r["size"] for r in telemetry.dynamic_budget(spark.createDataFrame(log, "run_id long, event_id long, value double"), 250.0, 100).collect()}
    assert got == {1: 100, 2: 100, 3: 390}
    assert telemetry.dynamic_budget(spark.createDataFrame([], "run_id long, event_id long, value double"), 1.0, 1).count() == 0


def test_color_rounds_by_numpy(spark):
    r = random.Random(6)
    data = [(0, i, k, 0, *[r.random() for _ in range(6)]) for i in range(2) for k in range(60)]
    df = spark.createDataFrame(data, "scene_id long, image_id long, y long, x long, r double, g double, b double, ref_r double, ref_g double, ref_b double")
    got = {(x["image_id"], x["y"]): [x[c] for c in "rgb"] for x in pixels.color_correct(df, 3).collect()}
    free = lambda z: (z >= 0.5 / 255) & (z <= 1 - 0.5 / 255)
    for i in range(2):
        own = np.array([d[4:] for d in data if d[1] == i])
        first, now, ref = own[:, :3], own[:, :3], own[:, 3:]
        for _ in range(3):
            a = np.column_stack([now, *[now[:, p] * now[:, q] for p in range(3) for q in range(p, 3)], np.ones(60)])
            put = []
            for c in range(3):
                ok = free(first[:, c]) & free(now[:, c]) & free(ref[:, c])
                put.append(np.linalg.lstsq(a[ok], ref[ok, c], rcond=None)[0])
            now = np.clip(a @ np.array(put).T, 0, 1)
        assert np.allclose([got[i, k] for k in range(60)], now, atol=1e-6)


def test_box_spans_of_all_ways_behind_the_camera(spark):
    """The outline holds the rounded place of every way from a corner in sight to one that isn't, as the SQL twin has it."""
    r = random.Random(5)
    boxes, images, want = [], [], {}
    for k in range(300):
        m, t = turned(r), [r.uniform(-1, 1) for _ in range(3)]
        centre, size, yaw = [r.uniform(-2, 2) for _ in range(3)], [r.uniform(0.5, 4) for _ in range(3)], r.uniform(-3, 3)
        boxes.append((0, k, k, *centre, *size, yaw))
        images.append((0, k, flat(m, t), 8.0, 8.0, 5.0, 5.0, k, 10, 10))
        corners = []
        for a, b, c in np.ndindex(2, 2, 2):
            dx, dy = (a - 0.5) * size[0], (b - 0.5) * size[1]
            p = [centre[0] + math.cos(yaw) * dx - math.sin(yaw) * dy - t[0], centre[1] + math.sin(yaw) * dx + math.cos(yaw) * dy - t[1], centre[2] + (c - 0.5) * size[2] - t[2]]
            x, y, z = m.T @ p
            corners.append((x, y, -z))
        ahead, behind = [p for p in corners if p[2] > 0.01], [p for p in corners if p[2] <= 0.01]
        ends = ahead + [(*[p[i] + (q[i] - p[i]) * (p[2] - 0.01) / (p[2] - q[2]) for i in (0, 1)], 0.01) for p in ahead for q in behind]
        want[k] = hull_pixels([(round(8 * x / d + 5), round(5 - 8 * y / d)) for x, y, d in ends], 10, 10) if ends else set()
    got = {k: set() for k in want}
    for s in joins.box_spans(spark.createDataFrame(boxes, BOX), spark.createDataFrame(images, IMAGE)).collect():
        got[s["box_id"]] |= {(x, s["y"]) for x in range(s["x0"], s["x1"] + 1)}
    assert got == want and sum(map(len, want.values())) > 500


def test_boxes_out_of_view_are_left_out_before_corners(spark):
    """Pairs go by the planes of the view; none that the image sees is lost."""
    r = random.Random(9)
    boxes = [(0, 0, k, *[r.uniform(-9, 9) for _ in range(3)], *[r.uniform(0.1, 2) for _ in range(3)], r.uniform(-3, 3)) for k in range(300)]
    images = [(0, k, flat(turned(r), [r.uniform(-9, 9) for _ in range(3)]), 500.0, 510.0, 320.0, 240.0, 0, 643, 481) for k in range(8)]
    pairs = joins.boxes_near_view(spark.createDataFrame(boxes, BOX), spark.createDataFrame(images, IMAGE))
    met = {(p["image_id"], p["box_id"]) for p in pairs.collect()}
    seen = set()
    for _, i, c2w, *_ in images:
        m = np.array(c2w).reshape(3, 4)
        for _, _, k, *v in boxes:
            ends = np.array([np.array(v[:3]) + [math.cos(v[6]) * a * v[3] - math.sin(v[6]) * b * v[4], math.sin(v[6]) * a * v[3] + math.cos(v[6]) * b * v[4], c * v[5]] - m[:, 3] for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]) @ m[:, :3]
            ahead = ends[ends[:, 2] < -0.01]
            if any(0 < 320 - 500 * x / z < 643 and 0 < 240 + 510 * y / z < 481 for x, y, z in ahead):
                seen.add((i, k))
    assert seen <= met and len(seen) > 50 and len(met) < 0.3 * len(boxes) * len(images)


def test_lens_is_taken_out_once_a_pixel(spark):
    """Rays of a lens as by ``undistort``; the plan names the Newton steps once, not wherever a place is used."""
    lens = {"k1": 0.05, "k2": -0.01, "k3": 0.002, "k4": -0.001, "p1": 0.001, "p2": -0.002}
    c = spark.createDataFrame([(0, 0, flat(np.eye(3), [0.0, 0.0, 0.0]), 8.0, 9.0, 5.0, 4.0)], VIEW).withColumns({**{k: F.lit(v) for k, v in lens.items()}, "camera_type": F.lit("perspective")})
    px = spark.createDataFrame([(0, 0, y, x) for y in range(9) for x in range(11)], "scene_id long, image_id long, y long, x long")
    rays_ = cameras.camera_rays(px, c, distorted=True)
    plan = rays_._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 0 and plan.count("_undistorted(") == 1
    want = px.withColumn("p", cameras.undistort((F.col("x") + 0.5 - 5) / 8, (F.col("y") + 0.5 - 4) / 9, {k: F.lit(v) for k, v in lens.items()}))
    want = {(r["y"], r["x"]): r["p"] for r in want.collect()}
    got = {(r["y"], r["x"]): (r["dx"] / -r["dz"], -r["dy"] / -r["dz"]) for r in rays_.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
