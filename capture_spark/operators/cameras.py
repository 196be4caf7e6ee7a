"""Camera models: normalisation, lens distortion, rays of all projections, panoramas cut into views."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capture_spark.operators.scenes import dot, matvec, pose_of

#: The place of each intrinsic in a model's parameters (None: 0), and the camera model that it becomes.
MODELS = {
    "SIMPLE_PINHOLE": ("OPENCV", {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2}),
    "PINHOLE": ("OPENCV", {"fl_x": 0, "fl_y": 1, "cx": 2, "cy": 3}),
    "SIMPLE_RADIAL": ("OPENCV", {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2, "k1": 3}),
    "RADIAL": ("OPENCV", {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2, "k1": 3, "k2": 4}),
    "OPENCV": ("OPENCV", {"fl_x": 0, "fl_y": 1, "cx": 2, "cy": 3, "k1": 4, "k2": 5, "p1": 6, "p2": 7}),
    "OPENCV_FISHEYE": ("OPENCV_FISHEYE", {"fl_x": 0, "fl_y": 1, "cx": 2, "cy": 3, "k1": 4, "k2": 5, "k3": 6, "k4": 7}),
    "SIMPLE_RADIAL_FISHEYE": ("OPENCV_FISHEYE", {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2, "k1": 3}),
    "RADIAL_FISHEYE": ("OPENCV_FISHEYE", {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2, "k1": 3, "k2": 4}),
}
TYPES = {"OPENCV": "perspective", "OPENCV_FISHEYE": "fisheye", "EQUIRECTANGULAR": "equirectangular", "ORTHOPHOTO": "orthophoto"}
ROUNDS, LEAST = 10, 1e-3  # Newton steps of a lens, and the determinant under which none is made
INTRINSICS = ("fl_x", "fl_y", "cx", "cy", "k1", "k2", "k3", "k4", "p1", "p2")


def normalise_cameras(cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One intrinsics struct for all models, as columns; and the cameras of models that are not known, or lack parameters."""
    chosen, kind, size = dict.fromkeys(INTRINSICS, F.lit(None).cast("double")), F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (model, at) in MODELS.items():
        hit = F.col("model") == name
        kind, size = F.when(hit, model).otherwise(kind), F.when(hit, max(at.values()) + 1).otherwise(size)
        chosen = {c: F.when(hit, F.get("params", F.lit(at[c])) if c in at else F.lit(0.0)).otherwise(x) for c, x in chosen.items()}
    c = cameras.withColumn("camera_model", F.when(F.size("params") >= size, kind))
    good = c.filter("camera_model IS NOT NULL").withColumns(chosen)
    return good.drop("model", "params"), c.filter("camera_model IS NULL").drop("camera_model")


def undistort(x: Column, y: Column, lens: dict[str, Column], rounds: int = ROUNDS, least: float = LEAST) -> Column:
    """Struct (x, y) of undistorted coordinates by Newton steps on the radial and tangential model.

    A fold over the rounds, so the expression stays small; no step where the determinant is too small.
    """
    k = lambda c: lens.get(c, F.lit(0.0))

    def step(p: Column, _: Column) -> Column:
        u, v = p["x"], p["y"]
        r = u * u + v * v
        d = 1 + r * (k("k1") + r * (k("k2") + r * (k("k3") + r * k("k4"))))
        dr = k("k1") + r * (2 * k("k2") + r * (3 * k("k3") + r * 4 * k("k4")))
        fx = d * u + 2 * k("p1") * u * v + k("p2") * (r + 2 * u * u) - x
        fy = d * v + 2 * k("p2") * u * v + k("p1") * (r + 2 * v * v) - y
        fx_x = d + 2 * u * dr * u + 2 * k("p1") * v + 6 * k("p2") * u
        fx_y = 2 * v * dr * u + 2 * k("p1") * u + 2 * k("p2") * v
        fy_x = 2 * u * dr * v + 2 * k("p2") * v + 2 * k("p1") * u
        fy_y = d + 2 * v * dr * v + 2 * k("p2") * u + 6 * k("p1") * v
        det = fy_x * fx_y - fx_x * fy_y
        safe = F.when(F.abs(det) > least, det)
        return F.struct((u + F.coalesce((fx * fy_y - fy * fx_y) / safe, F.lit(0.0))).alias("x"), (v + F.coalesce((fy * fx_x - fx * fy_x) / safe, F.lit(0.0))).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), step)


def _undistorted(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series, k4: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
    """``undistort`` of three places of each row, a batch at once, so that a place is worked out once however often it is named."""
    c1, c2, c3, c4, q1, q2 = (k.fillna(0.0).to_numpy(float) for k in (k1, k2, k3, k4, p1, p2))
    out = {}
    with np.errstate(all="ignore"):
        for name, x, y in (("a", ax, ay), ("b", bx, by), ("c", cx, cy)):
            x, y = x.to_numpy(float), y.to_numpy(float)
            u, v = x, y
            for _ in range(ROUNDS):
                r = u * u + v * v
                d = 1 + r * (c1 + r * (c2 + r * (c3 + r * c4)))
                dr = c1 + r * (2 * c2 + r * (3 * c3 + r * 4 * c4))
                fx = d * u + 2 * q1 * u * v + q2 * (r + 2 * u * u) - x
                fy = d * v + 2 * q2 * u * v + q1 * (r + 2 * v * v) - y
                fx_x = d + 2 * u * dr * u + 2 * q1 * v + 6 * q2 * u
                fx_y = 2 * v * dr * u + 2 * q1 * u + 2 * q2 * v
                fy_x = 2 * u * dr * v + 2 * q2 * v + 2 * q1 * u
                fy_y = d + 2 * v * dr * v + 2 * q2 * u + 6 * q1 * v
                det = fy_x * fx_y - fx_x * fy_y
                safe = np.abs(det) > LEAST
                step = np.where(safe, det, 1.0)
                u, v = u + np.where(safe, (fx * fy_y - fy * fx_y) / step, 0.0), v + np.where(safe, (fy * fx_x - fx * fy_x) / step, 0.0)
            out |= {f"{name}x": u, f"{name}y": v}
    return pd.DataFrame(out)


def _direction(kind: Column, u: Column, v: Column) -> list[Column]:
    """Direction in the camera frame of image coordinates (right, up), by camera type."""
    angle = F.greatest(F.least(F.sqrt(u * u + v * v), F.lit(math.pi)), F.lit(0.0))
    bend = F.when(angle == 0, 1.0).otherwise(F.sin(angle) / F.when(angle == 0, 1.0).otherwise(angle))
    theta, phi = -math.pi * u, math.pi * (0.5 - v)
    pick = lambda fish, pano, flat, plain: F.when(kind == "fisheye", fish).when(kind == "equirectangular", pano).when(kind == "orthophoto", flat).otherwise(plain)
    return [
        pick(u * bend, -F.sin(theta) * F.sin(phi), F.lit(0.0), u),
        pick(v * bend, F.cos(phi), F.lit(0.0), v),
        pick(-F.cos(angle), -F.cos(theta) * F.sin(phi), F.lit(-1.0), F.lit(-1.0)),
    ]


def camera_rays(pixels: DataFrame, cameras: DataFrame, distorted: bool = False) -> DataFrame:
    """World rays of pixels: origin, unit direction, norm and pixel area (scene_id, image_id, y, x, ox ... dz, norm, area).

    ``cameras`` has (scene_id, image_id), camera_type (perspective, fisheye,
    equirectangular, orthophoto), fx, fy, cx, cy and c2w; with ``distorted`` also
    k1 ... k4, p1 and p2, which are taken out but for panoramas.  The area is that
    between the direction and those one pixel right and one down.
    """
    p = pixels.select("scene_id", "image_id", "y", "x").join(cameras, ["scene_id", "image_id"])
    kind = F.col("camera_type")
    at = {}
    for name, (dx, dy) in {"a": (0, 0), "b": (1, 0), "c": (0, 1)}.items():
        at |= {f"{name}x": (F.col("x") + (0.5 + dx) - F.col("cx")) / F.col("fx"), f"{name}y": (F.col("y") + (0.5 + dy) - F.col("cy")) / F.col("fy")}
    if distorted:
        p = p.withColumn("_at", F.pandas_udf(_undistorted, "ax double, ay double, bx double, by double, cx double, cy double")(*at.values(), *[F.col(c).cast("double") for c in ("k1", "k2", "k3", "k4", "p1", "p2")]))
        at = {c: F.when(kind == "equirectangular", x).otherwise(F.col(f"_at.{c}")) for c, x in at.items()}
    p = p.withColumns({f"at_{name}": F.struct(at[f"{name}x"].alias("x"), at[f"{name}y"].alias("y")) for name in "abc"})
    r, t = pose_of(F.col("c2w"))
    made = {}
    for name in "abc":
        d = matvec(r, _direction(kind, F.col(f"at_{name}.x"), -F.col(f"at_{name}.y")))
        made |= {f"{name}{k}": x for k, x in enumerate(d)}
    p = p.withColumns(made)
    n = {name: F.sqrt(dot([F.col(f"{name}{k}") for k in range(3)], [F.col(f"{name}{k}") for k in range(3)])) for name in "abc"}
    unit = {name: [F.col(f"{name}{k}") / n[name] for k in range(3)] for name in "abc"}
    gap = lambda q: F.sqrt(sum(((unit["a"][k] - unit[q][k]) ** 2 for k in (1, 2)), (unit["a"][0] - unit[q][0]) ** 2))
    grid = matvec(r, [F.col("at_a.x"), F.col("at_a.y"), F.lit(0.0)])  # an orthophoto's rays start on a plane
    origin = [F.when(kind == "orthophoto", x + g).otherwise(x) for x, g in zip(t, grid, strict=True)]
    return p.select("scene_id", "image_id", "y", "x", *[x.alias(f"o{c}") for x, c in zip(origin, "xyz", strict=True)], *[x.alias(f"d{c}") for x, c in zip(unit["a"], "xyz", strict=True)], n["a"].alias("norm"), (gap("b") * gap("c")).alias("area"))


def crop_pitches(pitches: list[float], fov: float, top: float, bottom: float) -> list[float | None]:
    """Ascending pitches moved off what is cropped at the top and bottom (shares of 180 degrees); None for those that would see nothing else.

    The first pitch inside moves to the edge, and those after it by half as much each.
    """
    out: list[float | None] = list(pitches)
    for share, sign in ((bottom, 1), (top, -1)):
        if share <= 0:
            continue
        edge = sign * (-90 + 180 * share + fov / 2)
        places = range(len(out)) if sign > 0 else range(len(out) - 1, -1, -1)
        for n, i in enumerate(places):
            if out[i] is None:
                continue
            if sign * out[i] < sign * edge - fov / 2:
                out[i] = None
            elif sign * out[i] < sign * edge:
                gap = edge - out[i]
                out[i] = edge
                for m, j in enumerate(list(places)[n + 1 :], 1):
                    if out[j] is not None:
                        out[j] += gap / 2**m
                break
    return out


def equirect_plan(images: DataFrame, count: int = 8, crop: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """(scene_id, image_id, view, yaw, pitch, fov, side, width, height): the views that a panorama is cut into.

    Eight or 14 views stand in three rows, four or six of them in the middle one.
    Crops (top, bottom, left, right) move or drop rows and narrow the range of
    yaws.  The side of a view is the root of height times width over the views.
    """
    fov, middle, other = {8: (120.0, 90, 180), 14: (110.0, 60, 90)}[count]
    low, up = -180 + 360 * crop[3], 180 - 360 * crop[2]
    rows = crop_pitches([-45.0, 0.0, 45.0], fov, crop[0], crop[1])
    plan = []
    for k, step in ((1, middle), (2, other), (0, other)):
        if rows[k] is not None:
            plan += [(low + step * j, rows[k]) for j in range(math.ceil((up - low) / step))]
    plan = [(k, float(yaw), float(pitch), fov) for k, (yaw, pitch) in enumerate(plan)]
    views = images.sparkSession.createDataFrame(plan, "view int, yaw double, pitch double, fov double")  # a few rows
    side = F.floor(F.sqrt(F.col("height") * F.col("width") / count))
    return images.select("scene_id", "image_id", side.alias("side"), "width", "height").join(F.broadcast(views))


def equirect_project(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    """(scene_id, image_id, view, y, x, value): each view's pixels from the nearest pixel of the panorama, by a join on its place."""
    v = plan.withColumn("y", F.explode(F.expr("sequence(0L, CAST(side AS BIGINT) - 1)"))).withColumn("x", F.explode(F.expr("sequence(0L, CAST(side AS BIGINT) - 1)")))
    focal = F.col("side") / 2 / F.tan(F.radians(F.col("fov") / 2))
    a, b = (F.col("x") + 0.5 - F.col("side") / 2) / focal, -(F.col("y") + 0.5 - F.col("side") / 2) / focal
    cp, sp = F.cos(F.radians("pitch")), F.sin(F.radians("pitch"))
    up, ahead = b * cp + sp, cp - b * sp  # turned by the pitch
    size = F.sqrt(a * a + up * up + ahead * ahead)
    yaw = F.atan2(a, ahead) + F.radians("yaw")
    col = F.pmod(F.floor((yaw / (2 * math.pi) + 0.5) * F.col("width")), F.col("width")).cast("long")
    row = F.greatest(F.least(F.floor((0.5 - F.asin(up / size) / math.pi) * F.col("height")), F.col("height") - 1), F.lit(0)).cast("long")
    v = v.select("scene_id", "image_id", "view", F.col("y").alias("vy"), F.col("x").alias("vx"), row.alias("y"), col.alias("x"))
    return v.join(pixels.select("scene_id", "image_id", "y", "x", "value"), ["scene_id", "image_id", "y", "x"]).select("scene_id", "image_id", "view", F.col("vy").alias("y"), F.col("vx").alias("x"), "value")
