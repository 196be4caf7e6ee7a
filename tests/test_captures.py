"""Capture queries against their SQL twins, and operators against exact small cases."""

import gzip
import json
import math
import os
import random
import shutil
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capture_spark.operators import cameras, joins, pixels, points, rays, sampling, scenes
from capture_spark.plans import catalog as captures
from capture_spark.sources import captures as files
from capture_spark.sources import formats

TABLES = "orders lineitem part events customer supplier embeddings".split()


def canon(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(df):
    return sorted((tuple(canon(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(captures.QUERIES))
def test_twin(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = rows(captures.QUERIES[name](spark, sf).toPandas())
    assert got == rows(db.sql(captures.ORACLES[name]).df()) if name in captures.ORACLES else got


def capture(tmp_path, scene, names, **extra):
    """A capture of our own: frames on a line, each with a focal length that the top level overrules."""
    os.makedirs(tmp_path / scene, exist_ok=True)
    frames = [{"file_path": f"images/{n}.png", "transform_matrix": [[1.0, 0, 0, float(k)], [0, 0, -1.0, 2.0], [0, 1.0, 0, -1.0], [0, 0, 0, 1.0]], "fl_x": 640.0 + k} for k, n in enumerate(names)]
    data = {"fl_x": 512.0, "fl_y": 520.0, "cx": 319.5, "cy": 241.0, "w": 640.0, "h": 480.0, "frames": frames, **extra}
    (tmp_path / scene / "transforms.json").write_text(json.dumps(data))


def test_transforms(spark, tmp_path):
    capture(tmp_path, "one", [f"f{k:02d}" for k in reversed(range(10))])
    capture(tmp_path, "two", ["b", "a", "c"], camera_model="OPENCV_FISHEYE")
    got = files.read_transforms(spark, f"{tmp_path}/*/transforms.json")
    assert got.groupBy("scene_id").count().orderBy("scene_id").collect() == [("one", 10), ("two", 3)]
    first = got.filter("scene_id = 'one' AND pos = 0").first()
    assert (first["file_path"], first["fl_x"], first["w"], first["c2w"][:4]) == ("images/f00.png", 512.0, 640.0, [1.0, 0.0, 0.0, 9.0])
    split = scenes.split_fraction(got.filter("scene_id = 'one'"), 0.9)
    assert [r["file_path"] for r in split.filter("split = 'eval'").collect()] == ["images/f08.png"]
    files.write_transforms(got.withColumn("camera_id", F.when(F.col("scene_id") == "one", 1).otherwise(F.col("pos"))), f"{tmp_path}/out")
    one, two = (json.loads((tmp_path / "out" / s / "transforms.json").read_text()) for s in ("one", "two"))
    assert (one["fl_x"], "fl_x" in one["frames"][0], "fl_x" in two, two["frames"][0]["fl_x"], two["camera_model"]) == (512.0, False, False, 512.0, "OPENCV_FISHEYE")
    back = files.read_transforms(spark, f"{tmp_path}/out/*/transforms.json")
    assert sorted(map(str, back.collect())) == sorted(map(str, got.select(back.columns).collect()))


def test_synthetic(spark, tmp_path):
    os.makedirs(tmp_path / "lego")
    (tmp_path / "lego" / "transforms_train.json").write_text(json.dumps({"camera_angle_x": 0.6911112070083618, "frames": [{"file_path": "./train/r_0", "rotation": 0.1, "transform_matrix": [[1, 0, 0, 0]] * 4}]}))
    r = files.read_synthetic(spark, f"{tmp_path}/*/transforms_*.json", 800, 800).first()
    assert math.isclose(r["focal"], 0.5 * 800 / math.tan(0.5 * 0.6911112070083618)) and (r["split"], r["file_path"], r["cx"]) == ("train", "train/r_0.png", 400.0)


def model(spark):
    """Two scenes with the same ids: cameras, images, points and observations."""
    cams = spark.createDataFrame([(s, 1, "OPENCV", 100, 150, [110.0, 110.0, 50.0, 75.0, 0.0, 0.0, 0.0, 0.0]) for s in "st"], "scene_id string, camera_id long, model string, width long, height long, params array<double>")
    ims = spark.createDataFrame([(s, i, [1.0, 0.0, 0.0, 0.0] if i == 1 else [0.5, 0.5, 0.5, 0.5], [0.5, 0.25, float(i) + (s == "t")], 1, f"{s}{i}.png") for s in "st" for i in (1, 2, 3)], "scene_id string, image_id long, qvec array<double>, tvec array<double>, camera_id long, name string")
    pts = spark.createDataFrame([(s, p, p * 1.0, -p / 2, 3.0 + (s == "t"), 10, 20, 30 + p, 0.5) for s in "st" for p in (7, 9)], "scene_id string, point3d_id long, x double, y double, z double, r int, g int, b int, error double")
    obs = spark.createDataFrame([(s, i, k, 1.5 + k, 2.5 * i, 7 if k == 0 else -1 if k == 1 else 9) for s in "st" for i in (1, 2) for k in range(3)], "scene_id string, image_id long, point2d_idx long, u double, v double, point3d_id long")
    return cams, ims, pts, obs


def same(a, b):
    return sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def binary(tmp_path, tables):
    """The same tables as binary models."""
    cams, ims, pts, obs = (t.collect() for t in tables)
    for s in {r["scene_id"] for r in cams}:
        os.makedirs(tmp_path / s, exist_ok=True)
        mine = lambda rows: [r for r in rows if r["scene_id"] == s]
        (tmp_path / s / "cameras.bin").write_bytes(struct.pack("<Q", len(mine(cams))) + b"".join(struct.pack("<iiQQ", r["camera_id"], 4, r["width"], r["height"]) + struct.pack("<8d", *r["params"]) for r in mine(cams)))
        out = struct.pack("<Q", len(mine(ims)))
        for r in mine(ims):
            o = sorted((x for x in mine(obs) if x["image_id"] == r["image_id"]), key=lambda x: x["point2d_idx"])
            out += struct.pack("<I7dI", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(o)) + b"".join(struct.pack("<ddq", x["u"], x["v"], x["point3d_id"]) for x in o)
        (tmp_path / s / "images.bin").write_bytes(out)
        out = struct.pack("<Q", len(mine(pts)))
        for r in mine(pts):
            o = [x for x in mine(obs) if x["point3d_id"] == r["point3d_id"]]
            out += struct.pack("<QdddBBBdQ", r["point3d_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"], len(o)) + b"".join(struct.pack("<ii", x["image_id"], x["point2d_idx"]) for x in o)
        (tmp_path / s / "points3D.bin").write_bytes(out)


def test_colmap_text_and_binary(spark, tmp_path):
    tables = model(spark)
    cams, ims, pts, obs = tables
    files.write_colmap_text(cams, ims, pts, obs, str(tmp_path / "text"))
    lines = (tmp_path / "text" / "s" / "images.txt").read_text().split("\n")
    assert lines[2].startswith("1 1.0 0.0 0.0 0.0 0.5 0.25 1.0 1 s1.png") and lines[7] == ""  # no observations in image 3
    binary(tmp_path / "bin", tables)
    tracks = pts.crossJoin(spark.range(1).select(F.lit(2).cast("long").alias("track_length"))).drop("id")
    for got in (files.read_colmap_text(spark, f"{tmp_path}/text"), files.read_colmap_bin(spark, f"{tmp_path}/bin")):
        assert all(same(a, b) for a, b in zip(got, (cams, ims, tracks, obs), strict=True))
    os.makedirs(tmp_path / "both" / "t")
    for s, kind in (("s", "text"), ("t", "bin")):
        shutil.copytree(tmp_path / kind / s, tmp_path / "both" / s, dirs_exist_ok=True)
    os.makedirs(tmp_path / "both" / "u")
    (tmp_path / "both" / "u" / "cameras.txt").write_text("# none\n")
    got, rejected = files.read_colmap(spark, f"{tmp_path}/both")
    assert all(same(a, b) for a, b in zip(got, (cams, ims, tracks, obs), strict=True)) and [r[0] for r in rejected.collect()] == ["u"]
    c2w = scenes.sfm_to_c2w(ims, keep_world=True).filter("image_id = 1 AND scene_id = 's'").first()["c2w"]
    assert c2w == [1.0, 0.0, 0.0, -0.5, 0.0, -1.0, 0.0, -0.25, 0.0, 0.0, -1.0, -1.0]
    frames = formats.read_phototourism(spark, f"{tmp_path}/bin")
    assert frames.count() == 0  # none of the cameras is a pinhole


def test_scenes_that_share_ids(spark):
    """Every operator over observations keeps scenes apart."""
    cams, ims, pts, obs = model(spark)
    images = scenes.sfm_to_c2w(ims, keep_world=True).join(cams.selectExpr("scene_id", "camera_id", "width", "height", "params[0] AS fx", "params[1] AS fy"), ["scene_id", "camera_id"])
    seen = obs.filter("point3d_id <> -1")
    depth = {(r["scene_id"], r["image_id"], r["px"]): r["depth"] for r in points.sfm_depth(seen, pts, images).collect()}
    assert depth["s", 1, 1] == 4000 and depth["t", 1, 1] == 6000 and len(depth) == 8  # z of the point plus that of the camera
    assert points.usable_observations(seen, pts, images).count() == 4  # image 2 has them behind it
    assert {tuple(r) for r in points.point_tracks(seen, 3).select("scene_id", "point3d_id", "n", "image_ids").collect() for r in [(r[0], r[1], r[2], tuple(r[3]))]} == {(s, p, 2, (1, 2, -1)) for s in "st" for p in (7, 9)}
    assert points.point_frequency(seen.withColumn("f2d", F.lit(1.0)), pts, images).count() == 4
    assert points.point_stats(seen, pts).filter("track = 2").count() == 4


def test_camera_models(spark):
    data = [(n, [float(k + 1) for k in range(12)]) for n in cameras.MODELS] + [("FOV", [1.0] * 5), ("FULL_OPENCV", [1.0] * 12), ("OPENCV", [1.0])]
    good, bad = cameras.normalise_cameras(spark.createDataFrame(data, "model string, params array<double>").withColumn("name", F.col("model")))
    got = {r["name"]: r for r in good.collect()}
    assert sorted(r["name"] for r in bad.collect()) == ["FOV", "FULL_OPENCV", "OPENCV"] and len(got) == 8
    assert (got["RADIAL"]["fl_y"], got["RADIAL"]["cx"], got["RADIAL"]["k2"], got["RADIAL"]["p1"]) == (1.0, 2.0, 5.0, 0.0)
    assert (got["OPENCV_FISHEYE"]["camera_model"], got["OPENCV_FISHEYE"]["k4"], got["PINHOLE"]["fl_y"]) == ("OPENCV_FISHEYE", 8.0, 2.0)


def test_undistort(spark):
    """Taking out a distortion that was put in gives the place back."""
    k1, k2, p1, p2 = 0.1, -0.02, 0.003, -0.002
    data = []
    for i in range(50):
        u, v = math.cos(i) * 0.5, math.sin(3 * i) * 0.4
        r = u * u + v * v
        d = 1 + k1 * r + k2 * r * r
        data.append((u, v, u * d + 2 * p1 * u * v + p2 * (r + 2 * u * u), v * d + 2 * p2 * u * v + p1 * (r + 2 * v * v)))
    lens = {"k1": F.lit(k1), "k2": F.lit(k2), "p1": F.lit(p1), "p2": F.lit(p2)}
    for r in spark.createDataFrame(data, "u double, v double, x double, y double").withColumn("p", cameras.undistort(F.col("x"), F.col("y"), lens)).collect():
        assert math.isclose(r["p"]["x"], r["u"], abs_tol=1e-9) and math.isclose(r["p"]["y"], r["v"], abs_tol=1e-9)


def test_rays_of_all_cameras(spark):
    """A camera at the origin: centre rays look along -z, panoramas up at the top row, orthophotos from a grid."""
    eye = [float(x) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)]
    cams = spark.createDataFrame([(0, k, t, 10.0, 10.0, 400.0, 400.0, eye) for k, t in enumerate(("perspective", "fisheye", "orthophoto"))] + [(0, 3, "equirectangular", 400.0, 400.0, 400.0, 200.0, eye)], "scene_id long, image_id long, camera_type string, fx double, fy double, cx double, cy double, c2w array<double>")
    px = spark.createDataFrame([(0, k, y, x) for k in range(3) for y, x in ((399.5, 399.5), (399.5, 409.5))] + [(0, 3, 199.5, 399.5), (0, 3, -0.5, 399.5), (0, 3, 199.5, 599.5)], "scene_id long, image_id long, y double, x double")
    got = {(r["image_id"], r["y"], r["x"]): [round(r[f"o{c}"], 9) + 0.0 for c in "xyz"] + [round(r[f"d{c}"], 6) + 0.0 for c in "xyz"] for r in cameras.camera_rays(px, cams).collect()}
    assert all(got[k, 399.5, 399.5] == [0, 0, 0, 0, 0, -1] for k in range(3))
    assert got[0, 399.5, 409.5][3:] == [round(math.sqrt(0.5), 6), 0, -round(math.sqrt(0.5), 6)]
    assert got[1, 399.5, 409.5][3:] == [round(math.sin(1), 6), 0, -round(math.cos(1), 6)]
    assert got[2, 399.5, 409.5] == [1, 0, 0, 0, 0, -1]
    assert got[3, 199.5, 399.5][3:] == [0, 0, -1] and got[3, -0.5, 399.5][3:] == [0, 1, 0] and got[3, 199.5, 599.5][3:] == [1, 0, 0]


def poses(spark, data):
    return spark.createDataFrame(data, "scene_id long, frame_id long, c2w array<double>")


def looking_at(o, at):
    """A pose at o that looks along -z at a point, x level."""
    z = np.array(o, float) - np.array(at, float)
    z /= np.linalg.norm(z)
    x = np.cross([0, 0, 1.0], z)
    x /= np.linalg.norm(x)
    y = np.cross(z, x)
    return [float(v) for row in np.column_stack([x, y, z, o]) for v in row]


def test_focus(spark):
    at = (0.5, -0.25, 1.0)
    ring = [(0, k, looking_at((3 * math.cos(k), 3 * math.sin(k), 0.5), at)) for k in range(6)] + [(0, 9, looking_at((0, 4, 0), (0, 8, 0.1)))]
    one = [(1, 0, looking_at((1, 2, 3), (0, 0, 0)))]
    got = {r["scene_id"]: r for r in scenes.scene_focus(poses(spark, ring + one)).collect()}
    assert all(math.isclose(got[0][f"f{c}"], v, abs_tol=1e-9) for c, v in zip("xyz", at)) and got[0]["cameras"] == 6
    assert [got[1][f"f{c}"] for c in "xyz"] == [1.0, 2.0, 3.0] and got[1]["cameras"] == 0


def test_orientation(spark):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    ring = []
    for k in range(12):
        p = np.array(looking_at((3 * math.cos(k), 2 * math.sin(k), 0.3 * (k % 3)), (0, 0, 0))).reshape(3, 4)
        ring.append((0, k, [float(v) for v in (turn @ p).ravel()]))
    r = scenes.orient_vertical(poses(spark, ring)).first()
    found = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(found @ turn @ [0, 0, 1], [0, 0, 1]) and np.allclose(found @ found.T, np.eye(3))
    r = scenes.orient_pca(poses(spark, ring)).first()
    found = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    moved = np.array([found @ (np.array(c).reshape(3, 4)[:, 3] - [r["cx"], r["cy"], r["cz"]]) for _, _, c in ring])
    spread = np.cov(moved.T)
    assert np.allclose(spread, np.diag(np.diag(spread)), atol=1e-9) and spread[0, 0] > spread[1, 1] > spread[2, 2] and np.isclose(np.linalg.det(found), 1)
    assert np.mean([(found @ np.array(c).reshape(3, 4)[:, :3])[2, 1] for _, _, c in ring]) > 0


def test_orders_of_cameras(spark):
    r = random.Random(4)
    at = {(s, k): [r.uniform(-1, 1) for _ in range(3)] for s in range(2) for k in range(15)}
    df = spark.createDataFrame([(s, k, *p, float(k % 4)) for (s, k), p in at.items()], "scene_id long, frame_id long, tx double, ty double, tz double, unsampled double")
    for s in range(2):
        left, path = set(range(1, 15)), [0]
        while left:
            path.append(min(left, key=lambda k: (math.dist(at[s, path[-1]], at[s, k]), k)))
            left.remove(path[-1])
        assert [x["frame_id"] for x in scenes.order_poses(df).filter(f"scene_id = {s}").orderBy("place").collect()] == path
        four = {k: [*at[s, k], 0.1 * (k % 4)] for k in range(15)}
        taken = [0]
        while len(taken) < 6:
            taken.append(max((k for k in four if k not in taken), key=lambda k: (min(math.dist(four[k], four[t]) for t in taken), -k)))
        assert [x["frame_id"] for x in scenes.farthest_first(df, 6).filter(f"scene_id = {s}").orderBy("place").collect()] == taken


def test_path_between_rotations(spark):
    a, b = looking_at((1, 0, 0), (0, 0, 0)), looking_at((0, 1, 0.5), (0, 0, 0))
    got = scenes.interpolate_path(poses(spark, [(0, 0, a), (0, 1, b)]), 5).orderBy("step").collect()
    ra, rb = (np.array(p).reshape(3, 4)[:, :3] for p in (a, b))

    def turn(q):
        w, x, y, z = q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])

    turns = [turn([r[f"q{c}"] for c in "wxyz"]) for r in got]
    assert np.allclose(turns[0], ra) and np.allclose(turns[4], rb)
    angle = lambda p, q: math.acos(min(1, (np.trace(p.T @ q) - 1) / 2))
    assert all(math.isclose(angle(turns[k], turns[k + 1]), angle(ra, rb) / 4, abs_tol=1e-6) for k in range(4))


def test_pose_delta(spark):
    a = looking_at((1, 0, 0), (0, 0, 0))
    r = np.array(a).reshape(3, 4)
    c, s = math.cos(0.3), math.sin(0.3)
    b = np.column_stack([r[:, :3] @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), r[:, 3] + [0, 0.5, 0]])
    x = scenes.pose_delta_stats(poses(spark, [(0, 0, a), (1, 0, a)]), poses(spark, [(0, 0, [float(v) for v in b.ravel()]), (1, 0, a)])).orderBy("scene_id").collect()
    assert math.isclose(x[0]["max_turn"], math.degrees(0.3)) and math.isclose(x[0]["max_shift"], 0.5) and x[1]["max_turn"] == 0


def test_normals_of_a_plane(spark):
    r = random.Random(5)
    data = [(0, k, (x := r.uniform(-1, 1)), (y := r.uniform(-1, 1)), 0.5 * x - 0.25 * y) for k in range(40)]
    df = spark.createDataFrame(data, "scene_id long, point3d_id long, x double, y double, z double")
    want = np.array([0.5, -0.25, -1.0]) / np.linalg.norm([0.5, -0.25, -1.0])
    for n in points.estimate_normals(df, 6, 0.5, view=(0.0, 0.0, 1.0)).collect():
        assert np.allclose([n["nx"], n["ny"], n["nz"]], want, atol=1e-6)


def test_nearest_of_odd_points(spark):
    """Points that are not finite take no part; many points at one place have each other."""
    data = [(0, k, 1.0, 2.0, 3.0) for k in range(30)] + [(0, 50, 1.5, 2.0, 3.0), (0, 60, float("nan"), 0.0, 0.0), (0, 61, float("inf"), 0.0, 0.0), (0, 62, None, 0.0, 0.0)]
    df = spark.createDataFrame(data, "scene_id long, point3d_id long, x double, y double, z double")
    got = {}
    for r in points.nearest(df, 2, 0.1).collect():
        got.setdefault(r["point3d_id"], {})[r["rank"]] = (r["other_id"], r["distance"])
    assert sorted(got) == [*range(30), 50] and got[0] == {1: (1, 0.0), 2: (2, 0.0)} and got[29] == {1: (0, 0.0), 2: (1, 0.0)} and got[50] == {1: (0, 0.5), 2: (1, 0.5)}


def test_color_correct(spark):
    r = random.Random(6)
    data = []
    for k in range(200):
        c = [r.uniform(0.1, 0.9) for _ in range(3)]
        data.append((0, 0, k, 0, *c, 0.8 * c[0] + 0.05, 0.5 * c[1] + 0.3 * c[1] * c[2] + 0.1, c[2] ** 2 * 0.5 + 0.2))
    df = spark.createDataFrame(data, "scene_id long, image_id long, y long, x long, r double, g double, b double, ref_r double, ref_g double, ref_b double")
    for x in pixels.color_correct(df, 1).collect():
        assert all(math.isclose(x[c], x[f"ref_{c}"], abs_tol=1e-6) for c in "rgb")


def test_samples(spark):
    ims = spark.createDataFrame([(s, i, 40, 30) for s in range(2) for i in range(3)], "scene_id long, image_id long, width long, height long")
    n = 6000
    a = sampling.sample_pixels(spark, ims, n, 1).toPandas()
    assert len(a) == n and a["x"].between(0, 39).all() and a["y"].between(0, 29).all() and (a.groupby(["scene_id", "image_id"]).size() - n / 6).abs().max() < 200
    assert abs(a["x"].mean() - 19.5) < 1 and sorted(map(tuple, a.to_numpy().tolist())) == sorted(map(tuple, sampling.sample_pixels(spark, ims, n, 1).toPandas().to_numpy().tolist()))
    e = sampling.sample_equirect(spark, ims, n, 2).toPandas()
    assert abs((e["y"] < 5).mean() - (1 - math.cos(math.pi / 6)) / 2) < 0.02 and e["y"].max() <= 29
    d = sampling.sample_disc(spark, ims, n, 10.0, 3).toPandas()
    assert len(d) == n and (((d["x"] + 0.5 - 20) ** 2 + (d["y"] + 0.5 - 15) ** 2) <= 121).all()  # a pixel's middle is within 0.71 of the place drawn and abs((((d["x"] - 20) ** 2 + (d["y"] - 15) ** 2) < 50).mean() - 0.5) < 0.05
    p = sampling.sample_patches(spark, ims, n, 5, 4).toPandas()
    assert len(p) == n // 25 * 25 and p["x"].max() <= 39 and all(g["x"].max() - g["x"].min() == 4 and len(g) == 25 for _, g in p.groupby("draw"))
    q = sampling.sample_pairs(spark, ims, n, 2, 5).toPandas().pivot(index="draw", columns="part", values=["x", "y"])
    assert len(q) == n // 2 and (q["x"][0] - q["x"][1]).abs().max() == 2
    patches = spark.createDataFrame([(0, 0, r, c, (r + c) % 3) for r in range(3) for c in range(4)], "scene_id long, image_id long, row long, col long, level long")
    got = sampling.sample_by_level(patches, ims, 1000, 4, 10, 6).toPandas()
    assert got.groupby("level").size().tolist() == sampling.level_counts(4, 1000) == [125, 208, 291, 376]
    known = got[got["level"] < 3]
    assert (((known["y"] // 10) + (known["x"] // 10)) % 3 == known["level"]).all() and (known["image_id"] == 0).all() and got[got["level"] == 3]["image_id"].nunique() == 3


def test_equirect_views(spark):
    pano = spark.createDataFrame([(0, 0, y, x, float(x)) for y in range(40) for x in range(80)], "scene_id long, image_id long, y long, x long, value double")
    ims = spark.createDataFrame([(0, 0, 80, 40)], "scene_id long, image_id long, width long, height long")
    plan = cameras.equirect_plan(ims, 8)
    assert [(r["yaw"], r["pitch"]) for r in plan.orderBy("view").collect()] == [(-180.0, 0.0), (-90.0, 0.0), (0.0, 0.0), (90.0, 0.0), (-180.0, 45.0), (0.0, 45.0), (-180.0, -45.0), (0.0, -45.0)]
    assert [(r["yaw"], r["pitch"]) for r in cameras.equirect_plan(ims, 8, (0.1, 0.0, 0.0, 0.0)).orderBy("view").collect()][::2][:4] == [(-180.0, -16.5), (0.0, -16.5), (-180.0, 12.0), (-180.0, -53.25)]
    got = cameras.equirect_project(pano, plan).toPandas()
    middle = got[(got["view"] == 2) & (got["y"] == 10) & (got["x"] == 10)]["value"].iloc[0]
    assert len(got) == 8 * 400 and abs(middle - 40) <= 2 and got[(got["view"] == 2) & (got["y"] == 10)].sort_values("x")["value"].is_monotonic_increasing


def test_boxes_in_images(spark):
    boxes = spark.createDataFrame([(0, 5, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (0, 5, 2, 8.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (1, 5, 1, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0, 0.0)], "scene_id long, sample_id long, box_id long, bx double, by double, bz double, sx double, sy double, sz double, yaw double")
    ims = spark.createDataFrame([(0, 3, 5, looking_at((5, 0, 0), (0, 0, 0)), 100.0, 100.0, 50.0, 40.0, 100, 80)], "scene_id long, image_id long, sample_id long, c2w array<double>, fx double, fy double, cx double, cy double, width int, height int")
    got = joins.project_boxes(boxes, ims).collect()
    side = 0.5 / 4.5 * 100
    assert [(r["box_id"], *[round(r[c], 6) for c in ("x0", "y0", "x1", "y1")]) for r in got] == [(1, *[round(v, 6) for v in (50 - side, 40 - side, 50 + side, 40 + side)])]
    px = spark.createDataFrame([(0, 3, 40, 50), (0, 3, 2, 2)], "scene_id long, image_id long, y long, x long")
    assert {(r["y"], r["keep"]) for r in joins.box_masks(px, joins.project_boxes(boxes, ims)).collect()} == {(40, False), (2, True)}


def put(path, data):
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


EYE4 = [[1.0, 0, 0, 1.0], [0, 1.0, 0, 2.0], [0, 0, 1.0, 3.0], [0, 0, 0, 1.0]]
K3 = [[500.0, 0, 320.0], [0, 510.0, 240.0], [0, 0, 1.0]]


def test_realitycapture(spark, tmp_path):
    put(tmp_path / "s" / "cams.csv", "#name,x,y,alt,heading,pitch,roll,f,px,py,k1,k2,k3,k4,t1,t2\na.jpg,1,2,3,90,0,0,36,0.1,0,0,0,0,0,0,0\nb.jpg,0,0,0,0,0,0,36,0,0,0,0,0,0,0,0\n")
    ims = spark.createDataFrame([("s", "a", "images/a.png", 200, 100), ("s", "c", "images/c.png", 200, 100)], "scene_id string, base_name string, file_path string, width int, height int")
    frames, summary = formats.read_realitycapture(spark, f"{tmp_path}/*/cams.csv", ims)
    r = frames.first()
    assert frames.count() == 1 and (r["fl_x"], r["cx"], r["cy"]) == (200.0, 120.0, 50.0) and np.allclose(r["c2w"], [0, 1, 0, 1, -1, 0, 0, 2, 0, 0, 1, 3])
    assert tuple(summary.first()) == ("s", 1, 1, 1)


def test_metashape(spark, tmp_path):
    pose16 = " ".join(str(v) for row in EYE4 for v in row)
    put(tmp_path / "s" / "cams.xml", f"""<?xml version="1.0"?><document><chunk><sensors><sensor id="0" type="frame"><resolution width="640" height="480"/><calibration><f>500</f><cx>1.5</cx><k1>0.1</k1></calibration></sensor><sensor id="1" type="frame"><resolution width="640" height="480"/></sensor></sensors>
<components><component id="7"><transform><rotation>0 -1 0 1 0 0 0 0 1</rotation><translation>2 0 0</translation><scale>2</scale></transform></component></components>
<cameras><camera id="0" label="a.b" sensor_id="0" component_id="7"><transform>{pose16}</transform></camera><camera id="1" label="c" sensor_id="0"><transform>{pose16}</transform></camera><camera id="2" label="d" sensor_id="1"><transform>{pose16}</transform></camera><camera id="3" label="e" sensor_id="0"></camera><camera id="4" label="gone" sensor_id="0"><transform>{pose16}</transform></camera></cameras></chunk></document>""")
    ims = spark.createDataFrame([("s", n, f"images/{n}.png") for n in "acde"], "scene_id string, base_name string, file_path string")
    frames, summary = formats.read_metashape(spark, f"{tmp_path}/*/cams.xml", ims)
    got = {r["file_path"]: r for r in frames.collect()}
    assert sorted(got) == ["images/a.png", "images/c.png"] and tuple(summary.first()) == ("s", 2, 2)
    assert (got["images/c.png"]["fl_x"], got["images/c.png"]["cx"], got["images/c.png"]["k1"], got["images/c.png"]["camera_model"]) == (500.0, 321.5, 0.1, "OPENCV")
    assert got["images/c.png"]["c2w"] == [0, 0, -1, 3, 1, 0, 0, 1, 0, -1, 0, 2] and np.allclose(got["images/a.png"]["c2w"], [0, 0, -1, 3, 0, 1, 0, -1, 1, 0, 0, 1])


def test_odm(spark, tmp_path):
    cam = {"v2 x": {"projection_type": "brown", "width": 400, "height": 300, "focal_x": 0.5, "focal_y": 0.5, "c_x": 0.01, "c_y": 0.0, "k1": 0.2}}
    for s in ("s", "t"):
        put(tmp_path / s / "cameras.json", cam)
    put(tmp_path / "s" / "reconstruction.json", [{"shots": {"a.jpg": {"rotation": [0.0, 0.0, math.pi / 2], "translation": [1.0, 2.0, 3.0]}, "x.jpg": {"rotation": [0.0, 0.0, 0.0], "translation": [0.0, 0.0, 0.0]}}}])
    put(tmp_path / "t" / "shots.geojson", {"features": [{"properties": {"filename": "a.jpg", "rotation": [0.0, 0.0, math.pi / 2], "translation": [1.0, 2.0, 3.0]}}]})
    ims = spark.createDataFrame([(s, "a", "images/a.png") for s in ("s", "t")], "scene_id string, base_name string, file_path string")
    frames, summary = formats.read_odm(spark, str(tmp_path), ims)
    got = {r["scene_id"]: r for r in frames.collect()}
    assert np.allclose(got["s"]["c2w"], [0, -1, 0, -2, -1, 0, 0, 1, 0, 0, -1, -3]) and np.allclose(got["t"]["c2w"], [0, 1, 0, 1, -1, 0, 0, 2, 0, 0, 1, 3])
    assert (got["s"]["fl_x"], got["s"]["cx"], got["s"]["k1"]) == (200.0, 199.51, 0.2) and sorted(map(tuple, summary.collect())) == [("s", 1, 1, 0), ("t", 1, 0, 0)]


def test_record3d_and_arkit(spark, tmp_path):
    put(tmp_path / "r" / "metadata.json", {"poses": [[0.0, 0.0, 0.0, 1.0, float(k), 0.0, 0.0] for k in range(10)], "K": [700.0, 0, 0, 0, 700.0, 0, 1, 2, 1], "w": 100, "h": 60})
    got = formats.read_record3d(spark, f"{tmp_path}/r/metadata.json", 4).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 3, 6, 9] and (got[1]["fl_x"], got[1]["cx"]) == (700.0, 50.0) and got[1]["c2w"] == [1, 0, 0, 3, 0, 1, 0, 0, 0, 0, 1, 0]
    put(tmp_path / "a" / "v" / "lowres_wide.traj", "10.0004 0 0 0 1 2 3\n10.1 0 0 0 0 0 0\n")
    put(tmp_path / "a" / "v" / "lowres_wide_intrinsics" / "v_10.000.pincam", "256 192 210 211 128 96\n")
    traj, lens = formats.read_arkit(spark, f"{tmp_path}/a")
    first = traj.orderBy("line").first()
    assert (first["ts"], first["c2w"]) == (10.0, [0, -1, 0, -2, 1, 0, 0, -1, 0, 0, 1, 3]) and tuple(lens.first()) == ("v", "10.000", 10.0, 256, 192, 210, 211, 128, 96)


def test_aria_and_driving(spark, tmp_path):
    put(tmp_path / "a" / "closed_loop_trajectory.csv", "tracking_timestamp_us,tx_world_device,ty_world_device,tz_world_device,qx_world_device,qy_world_device,qz_world_device,qw_world_device\n2500,1,2,3,0,0,0,1\n")
    with gzip.open(tmp_path / "a" / "semidense_points.csv.gz", "wt") as f:
        f.write("uid,graph_uid,px_world,py_world,pz_world,inv_dist_std,dist_std\n4,g,1,2,3,0.5,0.1\n")
    traj, cloud = formats.read_aria(spark, str(tmp_path))
    assert tuple(traj.first()) == ("a", 2500000, [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3]) and tuple(cloud.first()) == ("a", 4, 1, 2, 3, 0.5)
    eye = {"rotation": [1.0, 0.0, 0.0, 0.0], "translation": [1.0, 2.0, 3.0]}
    for name, rows_ in {"scene": [{"token": "sc", "name": "n"}], "sample": [{"token": "sa", "scene_token": "sc", "timestamp": 5}], "sample_data": [{"token": "d", "sample_token": "sa", "calibrated_sensor_token": "cs", "ego_pose_token": "ep", "filename": "f.jpg", "width": 4, "height": 3}], "calibrated_sensor": [{"token": "cs", "camera_intrinsic": K3, **eye}], "ego_pose": [{"token": "ep", **eye}]}.items():
        put(tmp_path / "d" / f"{name}.json", rows_)
    t = formats.read_driving(spark, str(tmp_path / "d"))
    star = joins.sensor_star(t["sample_data"], t["samples"], t["sensors"], t["egos"]).first()
    m = np.array(EYE4) @ np.array(EYE4)
    m = np.array([[0, -1, 0, 0], [0, 0, -1, 0], [1, 0, 0, 0], [0, 0, 0, 1]]) @ m
    m[:3, 1:3] *= -1
    m = m[[1, 0, 2, 3]]
    m[2] *= -1
    m = np.array([[0, 0, 1, 0], [0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 0, 1]]) @ m
    assert np.allclose(star["c2w"], m[:3].ravel()) and star["intrinsic"][0][0] == 500


def test_surface_sitcoms_dynamic(spark, tmp_path):
    frame = {"rgb_path": "a.png", "mono_depth_path": "d.npy", "intrinsics": K3, "camtoworld": EYE4}
    put(tmp_path / "u" / "meta_data.json", {"height": 480, "width": 640, "scene_box": {"aabb": [[-1, -1, -1], [1, 1, 1]]}, "frames": [frame, {**frame, "mono_normal_path": "n.npy"}, frame]})
    f, box = formats.read_surface(spark, f"{tmp_path}/u/meta_data.json", "val", 2)
    assert [r["pos"] for r in f.orderBy("pos").collect()] == [0, 2] and f.first()["depth_path"] is None and f.first()["c2w"] == [1, 0, 0, 1, 0, -1, 0, 2, 0, 0, -1, 3] and box.first()["aabb"] == [-1, -1, -1, 1, 1, 1]
    put(tmp_path / "i" / "cameras.json", {"bbox": [[0, 0, 0], [2, 4, 8]], "frames": [{"image_name": "a.png", "intrinsics": K3, "camtoworld": EYE4}]})
    f, box = formats.read_sitcoms(spark, f"{tmp_path}/i/cameras.json", 2.0)
    turn = np.array([[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    b = (turn @ np.array([[0, 0, 0], [2, 4, 8]], float).T).T
    scale = 2.0 / (b[1] - b[0]).max()
    p = turn @ np.array(EYE4)[:3]
    p[:, 3] = (p[:, 3] - b.mean(0)) * scale
    assert np.allclose(f.first()["c2w"], p.ravel()) and np.allclose(box.first()["aabb"], ((b - b.mean(0)) * scale).ravel())
    d = tmp_path / "y" / "s"
    put(d / "scene.json", {"center": [1.0, 0.0, 0.0], "scale": 2.0, "near": 0.1, "far": 5.0})
    put(d / "metadata.json", {"0_0": {"warp_id": 0, "camera_id": 0}, "0_4": {"warp_id": 4, "camera_id": 0}})
    put(d / "splits" / "train.json", {"frame_names": ["0_0", "0_4"], "time_ids": [0, 4]})
    for n in ("0_0", "0_4"):
        put(d / "camera" / f"{n}.json", {"orientation": [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], "position": [2.0, 3.0, 4.0], "focal_length": 100.0, "pixel_aspect_ratio": 1.5, "principal_point": [10.0, 20.0], "image_size": [33, 41]})
    f, s = formats.read_dynamic(spark, str(tmp_path / "y"), 1.0, 2)
    r = f.orderBy("pos").collect()[1]
    sf = 2.0 * (1.0 / 4 / (2.0 * 5.0))
    p = np.column_stack([np.array([[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]).T, (np.array([2.0, 3.0, 4.0]) - [1, 0, 0]) * sf])
    p[:, 1:3] *= -1
    p = p[[1, 0, 2]]
    p[2] *= -1
    p = p[[1, 2, 0]]
    assert np.allclose(r["c2w"], p.ravel()) and (r["fx"], r["fy"], r["cx"], r["w"], r["h"], r["time"], r["file_path"]) == (50.0, 75.0, 5.0, 16, 20, 1.0, "rgb/2x/0_4.png") and math.isclose(s.first()["far"], 5.0 * sf)


def test_pose_dirs_eyeful_paths(spark, tmp_path):
    for k, n in enumerate(("b", "a", "c")):
        put(tmp_path / "p" / "s" / "pose" / f"{n}.txt", "\n".join(" ".join(("-inf" if n == "c" and i == 0 else str(v)) for v in row) for i, row in enumerate(EYE4)))
        put(tmp_path / "p" / "s" / "intrinsics" / f"{n}.txt", f"{k} 0 0 0")
    got = formats.read_pose_dirs(spark, str(tmp_path / "p")).orderBy("position").collect()
    assert [(r["position"], r["intrinsics"][0]) for r in got] == [(0, 1.0), (1, 0.0)] and got[0]["pose"][3] == 1.0
    cam = {"distortionModel": "RadialAndTangential", "width": 800, "height": 600, "K": [[400.0, 0, 0], [0, 410.0, 0], [390.0, 310.0, 1.0]], "T": [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [1.0, 2.0, 3.0, 1.0]], "distortion": [0.1, 0.2, 0.3, 0.4, 0.5]}
    put(tmp_path / "e" / "s" / "cameras.json", {"KRT": [{**cam, "cameraId": "x"}, {**cam, "cameraId": "y", "width": 600, "height": 800}]})
    put(tmp_path / "e" / "s" / "splits.json", {"train": ["x"], "test": []})
    got = {r["camera"]: r for r in formats.read_eyeful(spark, str(tmp_path / "e"), 400, 300).collect()}
    assert (got["x"]["w"], got["x"]["fl_x"], got["x"]["cy"], got["x"]["k3"], got["x"]["p1"], got["x"]["split"], got["x"]["file_path"]) == (400, 200.0, 155.0, 0.5, 0.3, "train", "x.jpg")
    assert (got["y"]["w"], got["y"]["h"], got["y"]["split"]) == (300, 400, None) and got["x"]["c2w"] == [1, 0, 0, -1, 0, -1, 0, -2, 0, 0, -1, -3]
    put(tmp_path / "c" / "s" / "path.json", {"render_height": 100, "render_width": 200, "camera_path": [{"camera_to_world": [v for row in EYE4 for v in row], "fov": 90.0, "aspect": 1.0, "render_time": 0.5}]})
    r = formats.read_camera_path(spark, f"{tmp_path}/c/*/path.json").first()
    assert math.isclose(r["fx"], 50.0) and (r["camera_type"], r["time"], r["cx"], r["c2w"][3]) == ("perspective", 0.5, 100.0, 1.0)


def test_images_and_depth(spark, tmp_path):
    def png(path, arr):
        h, w, c = arr.shape
        raw = b"".join(b"\0" + arr[y].tobytes() for y in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    os.makedirs(tmp_path / "im")
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3) * 10
    png(tmp_path / "im" / "a.png", rgb)
    png(tmp_path / "im" / "b.png", np.dstack([rgb, np.full((2, 4, 1), 51, np.uint8)]))
    png(tmp_path / "im" / "c.png", rgb[:, :, :1].copy())
    (tmp_path / "im" / ".hidden.png").write_bytes(b"x")
    (tmp_path / "im" / "notes.txt").write_text("x")
    got = {(r["path"][-5], r["y"], r["x"]): r for r in formats.read_pixels(spark, f"{tmp_path}/im/*.png", (1.0, 1.0, 1.0)).collect()}
    assert len(got) == 24 and math.isclose(got["a", 1, 2]["g"], rgb[1, 2, 1] / 255) and math.isclose(got["b", 1, 2]["r"], rgb[1, 2, 0] / 255 * 0.2 + 0.8) and got["c", 0, 1]["r"] == got["c", 0, 1]["b"]
    names = [(r["path"].split("/")[-1], r["name"]) for r in files.list_images(spark, f"{tmp_path}/im").orderBy("path").collect()]
    assert names == [("a.png", "frame_00001.png"), ("b.png", "frame_00002.png"), ("c.png", "frame_00003.png")]
    np.save(tmp_path / "d.npy", np.arange(12.0).reshape(3, 4))
    d = {(r["y"], r["x"]): r["depth"] for r in formats.read_depth(spark, f"{tmp_path}/d.npy", 0.5, 2, 3).collect()}
    assert d == {(y, x): (4 * y + 2 * x) * 0.5 for y in range(3) for x in range(2)}


def test_polycam_exports_reports(spark, tmp_path):
    t = {f"t_{i}{j}": float(4 * i + j) for i in range(3) for j in range(4)}
    for n, blur in (("1", 50.0), ("2", 10.0), ("3", None)):
        put(tmp_path / "k" / f"{n}.json", {"fx": 10.0, "fy": 11.0, "cx": 12.0, "cy": 13.0, "width": 100, "height": 80, "blur_score": blur, **t})
    got = files.read_polycam(spark, f"{tmp_path}/k/*.json", 25.0, 5).orderBy("frame").collect()
    assert [r["frame"] for r in got] == ["1", "3"] and (got[0]["cx"], got[0]["w"], got[0]["c2w"][:4]) == (7.0, 90.0, [8.0, 9.0, 10.0, 11.0])
    f = spark.createDataFrame([("s", "train", "b.png", [0.0] * 12), ("s", "train", "a.png", [1.0] * 12), ("s", "eval", "c.png", [2.0] * 12)], "scene_id string, split string, file_path string, c2w array<double>")
    files.export_poses(f, f"{tmp_path}/poses")
    train = json.loads((tmp_path / "poses" / "s" / "transforms_train.json").read_text())
    assert [x["file_path"] for x in train] == ["a.png", "b.png"] and train[0]["transform"] == [[1.0] * 4] * 3
    files.write_eval(spark.createDataFrame([("s", "e", "m", "c", "psnr", 30.5), ("s", "e", "m", "c", "ssim", 0.9)], "scene_id string, experiment_name string, method_name string, checkpoint string, metric string, value double"), f"{tmp_path}/eval")
    assert json.loads((tmp_path / "eval" / "s" / "eval.json").read_text())["results"] == {"psnr": 30.5, "ssim": 0.9}
    s = spark.createDataFrame([("s", [float(k) for k in range(12)], 0.25)], "scene_id string, transform array<double>, scale double")
    files.write_scene_transforms(s, f"{tmp_path}/st")
    assert same(files.read_scene_transforms(spark, f"{tmp_path}/st/*/*.json"), s)


def test_ply(spark, tmp_path):
    df = spark.createDataFrame([(s, i, i * 0.5, -1.0 * i, 2.0, i, 255, 0) for s in "st" for i in range(5)], "scene_id string, point3d_id long, x double, y double, z double, r int, g int, b int")
    files.write_ply(df, f"{tmp_path}/out")
    assert (tmp_path / "out" / "s" / "points.ply").read_text().split("\n")[2] == "element vertex 5"
    assert same(files.read_ply(spark, f"{tmp_path}/out/*/points.ply"), df.drop("point3d_id"))
    splats = df.select("scene_id", F.col("point3d_id").alias("splat_id"), "x", "y", "z", *[F.col(c).cast("short").alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))], (F.col("x") * 3).alias("opacity"))
    files.write_splat_ply(splats, f"{tmp_path}/splats")
    raw = (tmp_path / "splats" / "t" / "splat.ply").read_bytes()
    assert raw.split(b"end_header\n")[0].endswith(b"property uchar blue\nproperty float opacity\n") and len(raw.split(b"end_header\n", 1)[1]) == 5 * (12 + 3 + 4)
    assert same(files.read_ply(spark, f"{tmp_path}/splats/*/splat.ply"), df.drop("point3d_id"))
    with pytest.raises(ValueError):
        files.write_splat_ply(splats.withColumn("opacity", F.when(F.col("splat_id") > 1, 1.0)), f"{tmp_path}/bad")


def test_late_rows_and_state(spark, tmp_path):
    """A moving average goes on from batch to batch; rows behind the watermark are counted."""
    from capture_spark.streaming import telemetry as live

    schema = "user_id long, event_type string, ts timestamp, event_id long, value double"
    parts = [[(1, "a", f"2024-01-01 00:0{k}:00", k, float(k)) for k in range(4)], [(1, "a", "2024-01-03 00:00:00", 4, 4.0), (1, "a", "2024-01-03 00:00:00", 4, 4.0)], [(1, "a", "2024-01-01 00:00:00", 9, 1.0), (1, "a", "2024-01-04 00:00:00", 5, 5.0)]]
    for k, rows_ in enumerate(parts):
        spark.createDataFrame(rows_, "user_id long, event_type string, t string, event_id long, value double").selectExpr("user_id", "event_type", "CAST(t AS TIMESTAMP) AS ts", "event_id", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 0:
            first = live.ingest(spark, f"{tmp_path}/in", schema, 1).selectExpr("user_id AS run_id", "event_type AS name", "ts", "event_id", "value")
        for name, stream in (("avg", live.moving_average(first, 2)), ("once", live.deduplicated(first, "1 hour"))):
            q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/log-{name}").trigger(availableNow=True).foreachBatch(lambda df, _, name=name: df.write.mode("append").parquet(f"{tmp_path}/{name}")).start()
            q.awaitTermination()
    assert {(r["event_id"], r["avg"]) for r in spark.read.parquet(f"{tmp_path}/avg").collect() if r["event_id"] < 5} == {(0, 0.0), (1, 0.5), (2, 1.5), (3, 2.5), (4, 3.5), (4, 4.0)}
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [0, 1, 2, 3, 4, 5] and live.late_rows(q) == 1


def test_box_hits_lie_on_a_face(spark):
    r = random.Random(0)
    data = [(0, i, *[r.uniform(-3, 3) for _ in range(3)], *[r.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(data, "scene_id long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    hit = {x["ray_id"]: x for x in rays.ray_box(df, (-1, -1, -1), (1, 1, 1)).collect()}
    assert any(x["far"] < 1e10 for x in hit.values())
    for _, i, *v in data:
        if hit[i]["far"] < 1e10:
            ends = ["far"] if hit[i]["near"] == 0 else ["near", "far"]
            for e in ends:
                assert math.isclose(max(abs(v[k] + hit[i][e] * v[3 + k]) for k in range(3)), 1.0, abs_tol=1e-6)


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([(0, k % 7, k // 7, 2.0 + k // 7, 1.0, 0.1 * (k % 5), 1.0, 0.5, 0.0) for k in range(70)], "scene_id long, ray_id long, sample_idx long, t_start double, delta double, density double, r double, g double, b double")
    left = {x["ray_id"]: x["m"] for x in df.groupBy("ray_id").agg({"density": "sum"}).withColumnRenamed("sum(density)", "m").collect()}
    for x in rays.composite(df).collect():
        assert math.isclose(x["accumulation"] + math.exp(-left[x["ray_id"]]), 1.0)


def test_total_variation(spark):
    board = spark.createDataFrame([(0, 0, y, x, float((x + y) % 2)) for y in range(10) for x in range(10)] + [(0, 1, y, x, 1.0) for y in range(10) for x in range(10)], "scene_id long, image_id long, y long, x long, gt double")
    assert {r["image_id"]: r["tv"] for r in pixels.total_variation(board).collect()} == {0: 4.0, 1: 0.0}


def test_seeded_frames(spark):
    f = spark.createDataFrame([(0, i, f"images/{i:05d}.png") for i in range(10)], "scene_id long, frame_id long, file_path string")
    a, b, c = ({r["frame_id"] for r in scenes.select_frames(f, 5, s).collect()} for s in (42, 42, 52))
    assert len(a) == len(c) == 5 and a == b != c


def test_knn_falls_back_to_far_points(spark):
    cloud = spark.createDataFrame([(0, i, float(10**i), 0.0, 0.0) for i in range(5)] + [(1, 9, 0.0, 0.0, 0.0)], "scene_id long, point3d_id long, x double, y double, z double")
    got = {}
    for r in points.nearest(cloud, 2, 0.5).collect():
        got.setdefault(r["point3d_id"], {})[r["rank"]] = r["other_id"]
    assert got == {0: {1: 1, 2: 2}, 1: {1: 0, 2: 2}, 2: {1: 1, 2: 0}, 3: {1: 2, 2: 1}, 4: {1: 3, 2: 2}}
