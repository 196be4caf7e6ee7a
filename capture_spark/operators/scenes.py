"""Scenes and frames: poses, normalisation, splits, subsamples, set operations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_spark.operators.trees import farthest_walk, nearest_walk
from capture_spark.shared import Scratch, numbered, settled

Vec = list[Column]
PART = 1 << 18  # frames that a task puts in order


def cols(*names: str) -> Vec:
    return [F.col(n) for n in names]


def dot(a: Vec, b: Vec) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def rotation(yaw: Column, pitch: Column) -> list[Vec]:
    """Camera-to-world rotation rows of a yaw about z after a pitch about y."""
    cy, sy, cp, sp = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch)
    return [[cy * cp, -sy, cy * sp], [sy * cp, cy, sy * sp], [-sp, F.lit(0.0), cp]]


def matvec(m: list[Vec], v: Vec) -> Vec:
    return [dot(row, v) for row in m]


def transposed(m: list[Vec]) -> list[Vec]:
    return [list(c) for c in zip(*m, strict=True)]


def matmul(a: list[Vec], b: list[Vec]) -> list[Vec]:
    return [[dot(row, col) for col in transposed(b)] for row in a]


def with_pose(frames: DataFrame) -> DataFrame:
    """Add ``c2w``, the 3x4 pose row by row."""
    r = rotation(F.col("yaw"), F.col("pitch"))
    t = cols("tx", "ty", "tz")
    return frames.withColumn("c2w", F.array(*[x for row, p in zip(r, t, strict=True) for x in (*row, p)]))


def pose_of(c2w: Column) -> tuple[list[Vec], Vec]:
    e = [F.element_at(c2w, i + 1) for i in range(12)]
    return [e[0:3], e[4:7], e[8:11]], [e[3], e[7], e[11]]


def pose(r: list[Vec], t: Vec) -> Column:
    return F.array(*[x for row, p in zip(r, t, strict=True) for x in (*row, p)])


def compose(a: Column, b: Column) -> Column:
    """The pose that applies b, then a."""
    (ra, ta), (rb, tb) = pose_of(a), pose_of(b)
    return pose(matmul(ra, rb), [x + y for x, y in zip(matvec(ra, tb), ta, strict=True)])


def invert(p: Column) -> Column:
    r, t = pose_of(p)
    back = transposed(r)
    return pose(back, [-x for x in matvec(back, t)])


def to_camera_convention(p: Column) -> Column:
    """OpenCV to OpenGL axes: the second and third columns change sign."""
    r, t = pose_of(p)
    return pose([[row[0], -row[1], -row[2]] for row in r], t)


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> list[Vec]:
    """Rotation rows of a unit quaternion, scalar first."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def sfm_to_c2w(images: DataFrame, keep_world: bool = False) -> DataFrame:
    """World-to-camera (qvec, tvec) to ``c2w``; unless ``keep_world``, world axes become z-up."""
    q, t = [F.element_at("qvec", i) for i in range(1, 5)], [F.element_at("tvec", i) for i in range(1, 4)]
    back = transposed(quaternion_rotation(*q))
    rows = [[x, -y, -z, -dot([x, y, z], t)] for x, y, z in back]  # by entries: nested arrays of them are too much for the optimizer
    if not keep_world:
        rows = [rows[0], rows[2], [-x for x in rows[1]]]
    return images.withColumn("c2w", F.array(*[x for row in rows for x in row]))


def scene_center(frames: DataFrame) -> DataFrame:
    return frames.groupBy("scene_id").agg(*[F.avg(f"t{c}").alias(f"c{c}") for c in "xyz"], F.count("*").alias("n_frames"))


def up_to_z(up: Vec) -> list[Vec]:
    """The rotation that takes a vector to +z (half a turn about x if it is -z, none for a vector of no length)."""
    n = F.sqrt(dot(up, up))
    a = [F.coalesce(F.try_divide(x, n), F.lit(z)) for x, z in zip(up, (0.0, 0.0, 1.0), strict=True)]
    flip = a[2] < -1 + 1e-8
    k = F.when(flip, 0.0).otherwise(1 / F.when(flip, 1.0).otherwise(1 + a[2]))
    s = a[0] * a[0] + a[1] * a[1]
    one = F.when(flip, -1.0).otherwise(1 - s * k)
    return [
        [F.when(flip, 1.0).otherwise(1 - a[0] * a[0] * k), -a[0] * a[1] * k, -a[0]],
        [-a[0] * a[1] * k, F.when(flip, -1.0).otherwise(1 - a[1] * a[1] * k), -a[1]],
        [a[0], a[1], one],
    ]


def orient_up(frames: DataFrame) -> DataFrame:
    """Per scene: centre of the cameras and the rotation (r00 ... r22) of their mean up axis to z."""
    r = rotation(F.col("yaw"), F.col("pitch"))
    mean = frames.groupBy("scene_id").agg(*[F.avg(f"t{c}").alias(f"c{c}") for c in "xyz"], *[F.avg(r[i][1]).alias(f"u{i}") for i in range(3)])
    turn = up_to_z(cols("u0", "u1", "u2"))
    return mean.select("scene_id", "cx", "cy", "cz", *[turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])


def _solved(sums: DataFrame, solve) -> DataFrame:
    """Per scene (one row each): the rotation rows r00 ... r22 that ``solve`` finds from the row's sums."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    kind = dict(sums.dtypes)["scene_id"]

    def run(batches):
        for b in batches:
            turns = np.array([solve(r) for r in b.to_dict("records")]).reshape(-1, 9)
            yield pd.DataFrame({"scene_id": b["scene_id"], **{c: b[c] for c in ("cx", "cy", "cz")}, **{n: turns[:, k] for k, n in enumerate(names)}})

    return sums.mapInPandas(run, f"scene_id {kind}, cx double, cy double, cz double, " + ", ".join(f"{n} double" for n in names))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that takes direction a to direction b."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    v, c = np.cross(a, b), float(a @ b)
    if c < -1 + 1e-8:
        return np.diag([1.0, -1.0, -1.0]) if abs(b[2]) > 0.5 else -np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def _axis_sums(frames: DataFrame, axis: int) -> list[Column]:
    r, _ = pose_of(F.col("c2w"))
    x = [r[i][axis] for i in range(3)]
    return [F.sum(x[i] * x[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)]


def orient_vertical(frames: DataFrame) -> DataFrame:
    """Per scene: centre and rotation (r00 ... r22) that turns upright the direction most square to all cameras' x axes.

    Where cameras are near parallel, the mean up axis is used, without its part along their common x axis.  ``frames`` has c2w.
    """
    r, t = pose_of(F.col("c2w"))
    sums = frames.groupBy("scene_id").agg(*[F.avg(x).alias(f"c{c}") for x, c in zip(t, "xyz", strict=True)], *[F.avg(r[i][1]).alias(f"u{i}") for i in range(3)], F.count("*").alias("n"), *_axis_sums(frames, 0))

    def solve(row: dict) -> np.ndarray:
        m = np.zeros((3, 3))
        for i in range(3):
            for j in range(i, 3):
                m[i, j] = m[j, i] = row[f"m{i}{j}"]
        value, vector = np.linalg.eigh(m)
        up = np.array([row[f"u{i}"] for i in range(3)])
        up = up / np.linalg.norm(up)
        if np.sqrt(max(value[1], 0)) > 0.17 * np.sqrt(row["n"]):
            up = vector[:, 0] * (1 if vector[:, 0] @ up > 0 else -1)
        else:
            up = up - vector[:, 2] * (vector[:, 2] @ up)
        return between(up, np.array([0.0, 0.0, 1.0]))

    return _solved(sums, solve)


def orient_pca(frames: DataFrame) -> DataFrame:
    """Per scene: centre and rotation onto the principal axes of the camera centres, widest first; rows 1 and 2 change sign where cameras would look down on average."""
    r, t = pose_of(F.col("c2w"))
    pairs = [F.covar_pop(t[i], t[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)]
    sums = frames.groupBy("scene_id").agg(*[F.avg(x).alias(f"c{c}") for x, c in zip(t, "xyz", strict=True)], *[F.avg(r[i][1]).alias(f"u{i}") for i in range(3)], *pairs)

    def solve(row: dict) -> np.ndarray:
        m = np.zeros((3, 3))
        for i in range(3):
            for j in range(i, 3):
                m[i, j] = m[j, i] = row[f"m{i}{j}"]
        vector = np.linalg.eigh(m)[1][:, ::-1]
        vector = vector * np.where(vector[np.abs(vector).argmax(0), range(3)] < 0, -1, 1)  # one of two signs, always the same
        if np.linalg.det(vector) < 0:
            vector[:, 2] = -vector[:, 2]
        turn = vector.T.copy()
        if turn[2] @ np.array([row[f"u{i}"] for i in range(3)]) < 0:
            turn[1:] = -turn[1:]
        return turn

    return _solved(sums, solve)


def scene_focus(frames: DataFrame, rounds: int = 10) -> DataFrame:
    """(scene_id, fx, fy, fz, cameras): the point nearest to all optical axes by least squares.

    Cameras that have it behind them leave and it is found anew, until none
    leaves or under two are left; scenes without two cameras keep their mean
    centre.  Each round is nine sums and one 3 x 3 solution per scene.
    """
    r, t = pose_of(F.col("c2w"))
    f = frames.select("scene_id", *[(-r[i][2]).alias(f"d{i}") for i in range(3)], *[x.alias(f"o{i}") for i, x in enumerate(t)])
    start = f.groupBy("scene_id").agg(*[F.avg(f"o{i}").alias(f"p{i}") for i in range(3)])
    found = start.withColumns({f"p{i}": F.lit(0.0) for i in range(3)})
    ahead = sum((F.col(f"d{i}") * (F.col(f"p{i}") - F.col(f"o{i}")) for i in (1, 2)), F.col("d0") * (F.col("p0") - F.col("o0"))) > 0
    kind = dict(frames.dtypes)["scene_id"]

    def solve(batches):
        for b in batches:
            m = np.array(b["m"].tolist(), float).reshape(-1, 3, 3)
            v = np.array(b["v"].tolist(), float).reshape(-1, 3)
            p = np.array([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(m, v, strict=True)]).reshape(-1, 3)
            yield pd.DataFrame({"scene_id": b["scene_id"], "n": b["n"], **{f"q{i}": p[:, i] for i in range(3)}})

    def settle(scratch) -> DataFrame:
        active, result, last = scratch.written(f), None, found
        for k in range(rounds):
            live = active.join(last.select("scene_id", "p0", "p1", "p2"), "scene_id").filter(ahead).select(*f.columns)
            live = scratch.written(live)
            # (I - dd')'(I - dd') = I - dd' for unit d
            e = lambda i, j: F.lit(1.0 if i == j else 0.0) - F.col(f"d{i}") * F.col(f"d{j}")
            sums = live.groupBy("scene_id").agg(F.count("*").alias("n"), F.array(*[F.avg(e(i, j)) for i in range(3) for j in range(3)]).alias("m"), F.array(*[F.avg(sum((e(i, j) * F.col(f"o{j}") for j in (1, 2)), e(i, 0) * F.col("o0"))) for i in range(3)]).alias("v"))
            new = scratch.written(sums.filter("n > 1").mapInPandas(solve, f"scene_id {kind}, n long, q0 double, q1 double, q2 double"))
            if not new.limit(1).count():
                break
            step = new.select("scene_id", *[F.col(f"q{i}").alias(f"p{i}") for i in range(3)], "n")
            result = step if result is None else result.join(step.select("scene_id"), "scene_id", "left_anti").unionByName(step)
            result = scratch.written(result)
            behind = live.join(step, "scene_id").filter(~ahead).select("scene_id").distinct()
            active = scratch.written(live.join(behind, "scene_id", "left_semi"))
            last = step
            if not active.limit(1).count():
                break
        if result is None:
            result = start.limit(0).withColumn("n", F.lit(0).cast("long"))
        out = start.select("scene_id", *[F.col(f"p{i}").alias(f"s{i}") for i in range(3)]).join(result, "scene_id", "left")
        return out.select("scene_id", *[F.coalesce(f"p{i}", f"s{i}").alias(f"f{c}") for i, c in enumerate("xyz")], F.coalesce("n", F.lit(0)).alias("cameras"))

    return settled(frames.sparkSession, "focus", settle)


def normalised(frames: DataFrame, factor: float = 1.0) -> DataFrame:
    """Frames centred, turned upright and scaled so that no coordinate exceeds ``factor``; with the scene's scale.

    A scene whose cameras are all at one place, or that has one camera, has scale 1.
    Two aggregates per scene; their rows are one per scene and meet the frames by a join on the scene.
    """
    moved = frames.join(orient_up(frames), "scene_id")
    t = matvec([cols(*[f"r{i}{j}" for j in range(3)]) for i in range(3)], [F.col(f"t{c}") - F.col(f"c{c}") for c in "xyz"])
    moved = moved.select(*frames.columns, *[x.alias(f"n{c}") for x, c in zip(t, "xyz", strict=True)])
    scale = moved.groupBy("scene_id").agg(F.coalesce(F.try_divide(F.lit(float(factor)), F.max(F.greatest(*[F.abs(f"n{c}") for c in "xyz"]))), F.lit(1.0)).alias("scale"))
    return moved.join(scale, "scene_id").withColumns({f"n{c}": F.col(f"n{c}") * F.col("scale") for c in "xyz"})


def scene_transforms(frames: DataFrame, factor: float = 1.0) -> DataFrame:
    """(scene_id, transform, scale): the 3x4 that centres a scene and turns it upright, and its scale."""
    turn = orient_up(frames)
    r = [cols(*[f"r{i}{j}" for j in range(3)]) for i in range(3)]
    t = matvec(r, [-F.col(f"c{c}") for c in "xyz"])
    scale = normalised(frames, factor).groupBy("scene_id").agg(F.first("scale").alias("scale"))
    return turn.select("scene_id", pose(r, t).alias("transform")).join(scale, "scene_id")


def to_scene_space(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """``c2w`` moved by its scene's transform, then translations times its scale."""
    r, t = pose_of(F.col("_p"))
    f = frames.join(scenes, "scene_id").withColumn("_p", compose(F.col("transform"), F.col("c2w")))
    return f.withColumn("c2w", pose(r, [x * F.col("scale") for x in t])).select(*frames.columns)


def to_original_space(frames: DataFrame, scenes: DataFrame, convention: str = "opencv") -> DataFrame:
    """Undo a scene's transform and scale on ``c2w``; ``opencv`` turns the camera axes as well.

    The transform's rotation part may be any invertible 3x3.
    """
    r, t = pose_of(F.col("c2w"))
    f = frames.join(scenes, "scene_id").withColumn("_p", pose(r, [x / F.col("scale") for x in t]))
    m, v = pose_of(F.col("transform"))
    cof = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = dot(m[0], cof[0])
    back = [[cof[j][i] / det for j in range(3)] for i in range(3)]
    f = f.withColumn("_b", pose(back, [-x for x in matvec(back, v)]))
    out = compose(F.col("_b"), F.col("_p"))
    f = f.withColumn("c2w", out)
    if convention == "opencv":
        f = f.withColumn("c2w", to_camera_convention(F.col("c2w")))
    elif convention != "opengl":
        raise ValueError(f"unknown convention {convention}")
    return f.select(*frames.columns)


def valid_poses(frames: DataFrame) -> DataFrame:
    """Frames whose pose is finite throughout."""
    return frames.filter(F.forall("c2w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def pose_faults(frames: DataFrame) -> DataFrame:
    """Per scene: frames with an infinite entry, and those with one that is not a number but none infinite."""
    infinite = F.exists("c2w", lambda x: F.abs(x) == float("inf"))
    nan = F.exists("c2w", lambda x: x.isNull() | F.isnan(x))
    return frames.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(infinite).alias("infinite"), F.count_if(nan & ~infinite).alias("not_a_number"))


def dynamic_scale(scenes: DataFrame, bound: float) -> DataFrame:
    """Scale of dynamic scenes from their metadata (scale, near, far): bound / 4 / (scale far), and near and far under it."""
    factor = F.lit(float(bound)) / 4 / (F.col("scale") * F.col("far"))
    s = scenes.withColumn("factor", factor).withColumn("_s", F.col("scale") * F.col("factor"))
    return s.withColumns({"near": F.col("near") * F.col("_s"), "far": F.col("far") * F.col("_s"), "scale": F.col("_s")}).drop("_s")


def auto_downscale(scenes: DataFrame, levels: DataFrame, most: int = 1600) -> DataFrame:
    """(scene_id, factor): halve a scene's images until their longer side is at most ``most`` or the next level's files are missing.

    ``scenes`` has width and height, ``levels`` the factors (2, 4 ...) that a scene has images of.
    """
    side = scenes.select("scene_id", F.greatest("width", "height").alias("side"))
    step = side.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("factor", F.pow(F.lit(2.0), "k").cast("long"))
    have = levels.select("scene_id", F.col("factor").cast("long").alias("next")).distinct().withColumn("have", F.lit(1))
    step = step.withColumn("next", F.col("factor") * 2).join(have, ["scene_id", "next"], "left")
    stop = (F.col("side") / F.col("factor") <= most) | F.col("have").isNull()
    return step.filter(stop).groupBy("scene_id").agg(F.min("factor").alias("factor"))


def scene_box(frames: DataFrame, factor: float = 1.0) -> DataFrame:
    return frames.groupBy("scene_id").agg(*[(F.min(f"t{c}") * factor).alias(f"min_{c}") for c in "xyz"], *[(F.max(f"t{c}") * factor).alias(f"max_{c}") for c in "xyz"])


def recentred_box(boxes: DataFrame, factor: float = 1.0) -> DataFrame:
    """Boxes moved to have their middle at the origin, and scaled."""
    half = {c: (F.col(f"max_{c}") - F.col(f"min_{c}")) / 2 * factor for c in "xyz"}
    return boxes.withColumns({f"min_{c}": -h for c, h in half.items()} | {f"max_{c}": h for c, h in half.items()})


def placed(frames: DataFrame) -> DataFrame:
    """Add ``idx``, the place in file order within the scene, and ``n``, the scene's frames.

    All rows are put in order by ranges of about ``PART`` rows, so a scene is many tasks;
    a scene's places begin where its first row stands.
    """
    scratch = Scratch(frames.sparkSession)
    rows = numbered(scratch, scratch.written(frames.drop("idx", "n")), ["scene_id", "file_path"], "idx", PART)
    begin = rows.groupBy(F.col("scene_id").alias("_scene")).agg(F.min("idx").alias("_first"), F.count("*").alias("n"))
    return rows.join(F.broadcast(begin), F.col("scene_id").eqNullSafe(F.col("_scene"))).withColumn("idx", F.col("idx") - F.col("_first")).drop("_scene", "_first")


def split_fraction(frames: DataFrame, fraction: float) -> DataFrame:
    """Add ``split``: evenly spaced train frames, the rest eval; steps are doubles, the last is the last frame.

    A frame is a train one if a step ends at it; only those near its place can, so each row tells by itself.
    """
    m = F.ceil(F.col("n") * F.lit(fraction))
    step = (F.col("n") - 1).cast("double") / F.greatest(m - 1, F.lit(1))
    near = F.when(step > 0, F.floor(F.col("idx") / step)).otherwise(0)

    def hit(j: Column) -> Column:
        at = F.when((j == m - 1) & (m > 1), F.col("n") - 1).otherwise(F.floor(j * step))
        return (j >= 0) & (j <= F.greatest(m - 1, F.lit(0))) & (at == F.col("idx"))

    train = F.exists(F.array(*[near + k for k in (-1, 0, 1, 2)]), hit) | ((m > 1) & (F.col("idx") == F.col("n") - 1))
    return placed(frames).withColumn("split", F.when(train, "train").otherwise("eval"))


def split_filename(frames: DataFrame) -> DataFrame:
    base = F.regexp_extract("file_path", "([^/]*)$", 1)
    return frames.withColumn("split", F.when(base.contains("train"), "train").when(base.contains("eval"), "eval"))


def split_interval(frames: DataFrame, every: int) -> DataFrame:
    return placed(frames).withColumn("split", F.when(F.col("idx") % every == 0, "eval").otherwise("train"))


def split_all(frames: DataFrame) -> DataFrame:
    return frames.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("eval"))))


def split_rig(frames: DataFrame, fraction: float, sample: Column) -> DataFrame:
    """Split the samples of a rig, then give each frame its sample's side."""
    f = frames.withColumn("sample", sample)
    samples = f.select("scene_id", F.col("sample")).distinct().withColumn("file_path", F.lpad(F.col("sample").cast("string"), 12, "0"))
    return f.join(split_fraction(samples, fraction).select("scene_id", "sample", "split"), ["scene_id", "sample"])


def split(frames: DataFrame, lists: DataFrame, mode: str = "fraction", fraction: float = 0.9, every: int = 8) -> DataFrame:
    """Add ``split``: by a scene's file lists where it has any, else by mode; val and test are one set, eval.

    ``lists`` has (scene_id, split, file_path).  Of a scene with lists, frames on
    none of them have no split and go.
    """
    side = F.when(F.col("split") == "train", "train").otherwise("eval")
    named = lists.select("scene_id", side.alias("split"), "file_path").distinct()
    has = lists.select("scene_id").distinct()
    listed = frames.join(named, ["scene_id", "file_path"])
    rest = frames.join(has, "scene_id", "left_anti")
    by = {"fraction": lambda f: split_fraction(f, fraction), "filename": split_filename, "interval": lambda f: split_interval(f, every), "all": split_all}[mode]
    return listed.select(*frames.columns, "split").unionByName(by(rest).select(*frames.columns, "split"))


def subset_with_splits(frames: DataFrame, lists: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """About k evenly spaced frames per scene, and the file lists without the names that went."""
    kept = even_subsample(frames, k)
    return kept, lists.join(kept.select("scene_id", "file_path"), ["scene_id", "file_path"], "left_semi")


def order_poses(frames: DataFrame) -> DataFrame:
    """Add ``place``: from the scene's first frame always on to the nearest centre not yet visited (ties to the earlier frame).

    Each step depends on the one before, so a scene's centres (three numbers a frame) are
    one task, which keeps them in k-d leaves with deletion.  Frames without a finite centre
    come last, in order.
    """
    schema = frames.select("scene_id", "frame_id").schema

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("frame_id", ignore_index=True)
        p = g[["tx", "ty", "tz"]].to_numpy(float)
        sound = np.isfinite(p).all(axis=1)
        rows = np.concatenate([np.flatnonzero(sound)[nearest_walk(p[sound])], np.flatnonzero(~sound)])
        place = np.empty(len(g), np.int64)
        place[rows] = np.arange(len(g))
        return pd.DataFrame({"scene_id": g["scene_id"], "frame_id": g["frame_id"], "place": place})

    found = frames.select("scene_id", "frame_id", "tx", "ty", "tz").groupBy("scene_id").applyInPandas(walk, schema.add("place", "long"))
    return frames.join(found, ["scene_id", "frame_id"])


def farthest_first(frames: DataFrame, k: int, weight: float = 0.1) -> DataFrame:
    """(scene_id, frame_id, place): k cameras of a scene, each the farthest from those before it.

    Distances are between centres and ``weight`` times ``unsampled``, the epochs
    since a camera was last taken.  A scene's centres are one task, which keeps them in
    k-d leaves and passes over those that a new camera can't come nearer to.  Frames
    without a finite centre are not taken.
    """
    schema = frames.select("scene_id", "frame_id").schema

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("frame_id", ignore_index=True)
        p = np.column_stack([g[["tx", "ty", "tz"]].to_numpy(float), weight * g["unsampled"].to_numpy(float)])
        sound = np.flatnonzero(np.isfinite(p).all(axis=1))
        taken = sound[farthest_walk(p[sound], k)]
        return pd.DataFrame({"scene_id": g["scene_id"].iloc[taken], "frame_id": g["frame_id"].iloc[taken], "place": np.arange(len(taken))})

    return frames.select("scene_id", "frame_id", "tx", "ty", "tz", "unsampled").groupBy("scene_id").applyInPandas(pick, schema.add("place", "long"))


def even_subsample(frames: DataFrame, k: int, mode: str = "round") -> DataFrame:
    """About ``k`` evenly spaced frames per scene; ``round`` half to even if n > k, ``trunc`` if n >= k."""
    f = placed(frames)
    enough = F.col("n") > k if mode == "round" else F.col("n") >= k
    at = F.col("j") * ((F.col("n") - 1).cast("double") / max(k - 1, 1))
    at = F.when(F.col("j") == k - 1, F.col("n") - 1).otherwise(F.rint(at) if mode == "round" else F.floor(at)).cast("long")
    wanted = f.groupBy("scene_id").agg(F.max("n").alias("n")).filter(enough).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("scene_id", at.alias("idx")).distinct()
    return f.filter(~enough).unionByName(f.filter(enough).join(wanted, ["scene_id", "idx"], "left_semi"), allowMissingColumns=True)


def select_frames(frames: DataFrame, target: int, seed: int | None = None) -> DataFrame:
    """Every n // target-th frame, or a seeded sample in order of a digest; all if there are too few."""
    f = placed(frames)
    if seed is None:
        step = F.greatest(F.floor(F.col("n") / target), F.lit(1))
        return f.filter((F.col("n") <= target) | ((F.col("idx") % step == 0) & (F.floor(F.col("idx") / step) < target)))
    by = Window.partitionBy("scene_id").orderBy(F.xxhash64(F.lit(seed), "idx"), "idx")
    return f.withColumn("place", F.row_number().over(by)).filter((F.col("n") <= target) | (F.col("place") <= target)).drop("place")


def filter_blur(frames: DataFrame, least: float) -> DataFrame:
    return frames.filter(F.col("blur_score").isNull() | (F.col("blur_score") >= least))


def blur_summary(frames: DataFrame, least: float) -> DataFrame:
    low = F.coalesce(F.col("blur_score") < least, F.lit(False))
    return frames.groupBy("scene_id").agg(F.count_if(low).alias("skipped"), F.count_if(~low).alias("kept"))


def divide_budget(frames: DataFrame, budget: int) -> DataFrame:
    """Even counts per image of a scene that add up to the budget; the last takes the rest."""
    base = F.floor(F.lit(budget) / F.col("n"))
    return placed(frames).withColumn("rays", F.when(F.col("idx") == F.col("n") - 1, budget - base * (F.col("n") - 1)).otherwise(base))


def rescale(frames: DataFrame, factor: float, mode: str = "floor") -> DataFrame:
    """Intrinsics and sizes times a factor; sizes by floor, round (half up) or ceil."""
    side = {"floor": lambda x: F.floor(x), "round": lambda x: F.floor(x + 0.5), "ceil": lambda x: F.ceil(x)}[mode]
    return frames.withColumns({**{c: F.col(c) * factor for c in ("fx", "fy", "cx", "cy")}, **{c: side(F.col(c) * F.lit(factor)).cast("int") for c in ("width", "height")}})


def tile_frames(cameras: DataFrame, n: int) -> DataFrame:
    """n x n tiles of each camera; remainders go to the first tiles, principal points shift."""
    t = cameras.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    out = {}
    for side, k, c in (("width", F.col("tile") % n, "cx"), ("height", F.floor(F.col("tile") / n).cast("int"), "cy")):
        base, rest = F.floor(F.col(side) / n).cast("int"), F.col(side) % n
        out[side] = base + F.when(k < rest, 1).otherwise(0)
        out[c] = F.col(c) - (base * k + F.least(k, rest))
    return t.withColumns(out)


def spiral_path(frames: DataFrame, steps: int, radius: float, turns: float, rate: float) -> DataFrame:
    """Camera centres on a spiral around each scene's first camera."""
    start = frames.groupBy("scene_id").agg(F.min_by(F.struct("tx", "ty", "tz"), "frame_id").alias("at"))
    angle = F.col("step") * (2 * 3.141592653589793 * turns / steps)
    s = start.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return s.select("scene_id", "step", (F.col("at.tx") + radius * F.cos(angle)).alias("x"), (F.col("at.ty") - radius * F.sin(angle)).alias("y"), (F.col("at.tz") - radius * F.sin(angle * rate)).alias("z"))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def spiral_poses(frames: DataFrame, cameras: DataFrame, steps: int, radii: tuple[float, float, float], turns: float, rate: float) -> DataFrame:
    """(scene_id, step, c2w, fx, fy, cx, cy, time): cameras on a spiral in the axes of each scene's first camera.

    Each looks away from the point one focal length (the smaller of fx and fy) behind
    the first camera, with that camera's backward axis as up; where up and line
    of sight agree, its own right axis stays.  All have its intrinsics, and times
    go from 0 to 1.  A scene without frames, or whose first camera is unknown, has no path.
    """
    first = frames.groupBy("scene_id").agg(F.min_by(F.struct("camera_id", "c2w"), "frame_id").alias("at")).select("scene_id", "at.camera_id", "at.c2w")
    s = first.join(cameras.select("scene_id", "camera_id", "fx", "fy", "cx", "cy"), ["scene_id", "camera_id"])
    s = s.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    angle = F.col("step") * (2 * math.pi * turns / steps)
    centre = [x * r for x, r in zip((F.cos(angle), -F.sin(angle), -F.sin(angle * rate)), radii, strict=True)]
    s = s.withColumns(dict(zip(("_x", "_y", "_z"), centre, strict=True)))
    at = cols("_x", "_y", "_z")
    r, _ = pose_of(F.col("c2w"))
    up = [row[2] for row in r]

    def unit(v: Vec, otherwise: tuple[float, float, float]) -> Vec:
        n = F.sqrt(dot(v, v))
        return [F.when(n > 1e-12, x / F.when(n > 1e-12, n).otherwise(1.0)).otherwise(o) for x, o in zip(v, otherwise, strict=True)]

    back = unit([at[0], at[1], at[2] + F.least("fx", "fy")], (0.0, 0.0, 1.0))
    s = s.withColumns({f"_b{k}": x for k, x in enumerate(back)})
    back = cols("_b0", "_b1", "_b2")
    s = s.withColumns({f"_r{k}": x for k, x in enumerate(unit(cross(up, back), (1.0, 0.0, 0.0)))})
    right = cols("_r0", "_r1", "_r2")
    local = pose(transposed([right, cross(back, right), back]), at)
    return s.select("scene_id", "step", compose(F.col("c2w"), local).alias("c2w"), "fx", "fy", "cx", "cy", (F.col("step") / float(max(steps - 1, 1))).alias("time"))


def quaternion(r: list[Vec]) -> Vec:
    """The unit quaternion (w, x, y, z) of rotation rows, by the largest of its four parts."""
    t = r[0][0] + r[1][1] + r[2][2]
    parts = [t, 2 * r[0][0] - t, 2 * r[1][1] - t, 2 * r[2][2] - t]
    sums = {(0, 1): r[2][1] - r[1][2], (0, 2): r[0][2] - r[2][0], (0, 3): r[1][0] - r[0][1], (1, 2): r[0][1] + r[1][0], (1, 3): r[0][2] + r[2][0], (2, 3): r[1][2] + r[2][1]}
    top = F.greatest(*parts)
    size = 2 * F.sqrt(1 + top)

    def part(i: int) -> Column:
        out = F.lit(None).cast("double")
        for k in reversed(range(4)):
            out = F.when(parts[k] == top, size / 4 if i == k else sums[min(i, k), max(i, k)] / size).otherwise(out)
        return out

    return [part(i) for i in range(4)]


def slerp(a: Vec, b: Vec, s: Column) -> Vec:
    """From quaternion a to b along the shorter way; straight where they nearly agree."""
    d = dot(a, b)
    sign, d = F.when(d < 0, -1.0).otherwise(1.0), F.abs(d)
    angle = F.acos(F.least(d, F.lit(1.0)))
    close = d > 1 - 1e-10
    wa = F.when(close, 1 - s).otherwise(F.sin((1 - s) * angle) / F.sin(F.when(close, 1.0).otherwise(angle)))
    wb = F.when(close, s).otherwise(F.sin(s * angle) / F.sin(F.when(close, 1.0).otherwise(angle)))
    q = [wa * x + wb * sign * y for x, y in zip(a, b, strict=True)]
    n = F.sqrt(dot(q, q))
    return [x / n for x in q]


def interpolate_path(frames: DataFrame, steps: int, linear: tuple[str, ...] = ()) -> DataFrame:
    """(scene_id, frame_id, step, x, y, z, qw, qx, qy, qz, ...) between consecutive frames of a scene, both ends included.

    Centres and the columns in ``linear`` (focal lengths, time) move straight,
    rotations of ``c2w`` on the shortest arc.
    """
    r, t = pose_of(F.col("c2w"))
    q = quaternion(r)
    f = frames.select("scene_id", "frame_id", *[x.alias(f"a{k}") for k, x in enumerate([*t, *q])], *[F.col(c).cast("double").alias(f"l_{c}") for c in linear])
    by = Window.partitionBy("scene_id").orderBy("frame_id")
    moved = [f"a{k}" for k in range(7)] + [f"l_{c}" for c in linear]
    f = f.withColumns({f"e_{c}": F.lead(c).over(by) for c in moved}).filter("e_a0 IS NOT NULL")
    f = f.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    s = F.col("step") / float(max(steps - 1, 1))
    straight = lambda c: (1 - s) * F.col(c) + s * F.col(f"e_{c}")
    turn = slerp(cols("a3", "a4", "a5", "a6"), cols("e_a3", "e_a4", "e_a5", "e_a6"), s)
    out = f.select("scene_id", "frame_id", "step", *[straight(f"a{k}").alias(c) for k, c in enumerate("xyz")], *[x.alias(f"_q{c}") for x, c in zip(turn, "wxyz", strict=True)], *[straight(f"l_{c}").alias(c) for c in linear])
    tiny, sign = 1e-9, F.lit(1.0)  # of a quaternion and its negative, the one whose first part that is not 0 is positive
    for c in "zyxw":
        sign = F.when(F.col(f"_q{c}") < -tiny, -1.0).when(F.col(f"_q{c}") > tiny, 1.0).otherwise(sign)
    return out.select("scene_id", "frame_id", "step", "x", "y", "z", *[(sign * F.col(f"_q{c}")).alias(f"q{c}") for c in "wxyz"], *linear)


def derive_paths(frames: DataFrame) -> DataFrame:
    """Mask and depth paths beside the image path."""
    return frames.withColumns({"mask_path": F.regexp_replace("file_path", "^images/", "masks/"), "depth_path": F.regexp_replace(F.regexp_replace("file_path", "^images/", "depth/"), r"\.png$", ".npy")})


def latest_checkpoint(files: DataFrame) -> DataFrame:
    step = F.regexp_extract("file_path", r"(\d+)\.[^.]*$", 1).cast("long")
    return files.groupBy("scene_id").agg(F.max_by("file_path", step).alias("file_path"), F.max(step).alias("step"))


def catalogue(scenes: DataFrame) -> DataFrame:
    """Scenes by number of images (n) and by largest side of an image (side), with subtotals (null) of both."""
    size = F.when(F.col("n") < 250, "<250").when(F.col("n") < 1000, "250-999").when(F.col("n") < 4000, "1000-3999").otherwise(">=4000")
    side = F.when(F.col("side") < 640, "<640").when(F.col("side") < 1280, "640-1279").when(F.col("side") < 1920, "1280-1919").when(F.col("side") < 3840, "1920-3839").otherwise(">=3840")
    return scenes.select(size.alias("images"), side.alias("resolution"), "side").cube("images", "resolution").agg(F.count("*").alias("scenes"), F.max("side").alias("most"))


def camera_variety(frames: DataFrame, most: int) -> DataFrame:
    """Scenes with more than ``most`` cameras."""
    return frames.groupBy("scene_id").agg(F.count_distinct("camera_id").alias("cameras")).filter(F.col("cameras") > most)


def pose_delta_stats(a: DataFrame, b: DataFrame, weights: tuple[float, float] = (1e-2, 1e-3)) -> DataFrame:
    """Per scene: largest and mean shift and turn (degrees) from ``c2w`` of a to that of b for the same frames, and the mean penalty of their squares."""
    x = a.select("scene_id", "frame_id", F.col("c2w").alias("a")).join(b.select("scene_id", "frame_id", F.col("c2w").alias("b")), ["scene_id", "frame_id"])
    (ra, ta), (rb, tb) = pose_of(F.col("a")), pose_of(F.col("b"))
    d = [q - p for p, q in zip(ta, tb, strict=True)]
    trace = sum((dot(p, q) for p, q in zip(ra[1:], rb[1:], strict=True)), dot(ra[0], rb[0]))
    # Half the chord between the rotations is exact for small angles, where the trace is not.
    chord = [p - q for u, v in zip(ra, rb, strict=True) for p, q in zip(u, v, strict=True)]
    sine = F.least(F.sqrt(dot(chord, chord)) / (2 * 2**0.5), F.lit(1.0))
    turn = F.when(trace > -0.9, 2 * F.asin(sine)).otherwise(F.acos(F.greatest((trace - 1) / 2, F.lit(-1.0))))
    x = x.select("scene_id", F.sqrt(dot(d, d)).alias("shift"), turn.alias("turn"))
    penalty = F.avg("shift") * weights[0] + F.avg("turn") * weights[1]
    return x.groupBy("scene_id").agg(F.max("shift").alias("max_shift"), F.avg("shift").alias("mean_shift"), F.max(F.degrees("turn")).alias("max_turn"), F.avg(F.degrees("turn")).alias("mean_turn"), penalty.alias("penalty"))


def union_splits(frames: DataFrame, order: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Frames of several split tables put after one another: ``position`` counts through the splits of a scene in that order."""
    rank = F.coalesce(*[F.when(F.col("split") == s, k) for k, s in enumerate(order)], F.lit(len(order)))
    by = Window.partitionBy("scene_id").orderBy(rank, "file_path")
    return frames.withColumn("position", F.row_number().over(by) - 1)
