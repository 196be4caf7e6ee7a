"""Registered queries: spiral paths with poses, imported poses, given boxes, and the ways back of colours and depths."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_spark.operators import pixels, points, rays, scenes
from capture_spark.plans.captures import POSE, WEIGHTS, add

_E = " ".join(f"e{k}" for k in range(1, 13))


def _parts(df, *keys: str):
    return df.select(*keys, *[F.element_at("c2w", k).alias(f"e{k}") for k in range(1, 13)])


def _spiral(frames, cameras):
    poses = scenes.spiral_poses(scenes.with_pose(frames), cameras, 12, (0.5, 0.4, 0.3), 2.0, 0.5)
    return poses.select("scene_id", "step", *[F.element_at("c2w", k).alias(f"e{k}") for k in range(1, 13)], "fx", "cy", "time")


_TURN = ", ".join(f"a{i}0*{v}0+a{i}1*{v}1+a{i}2*{v}2 AS e{4 * i + 1 + k}" for i in range(3) for k, v in enumerate("rub"))
add("p21_spiral_poses", "frames cameras", _spiral, "scene_id step", _E + " fx cy time",
    f"""SELECT scene_id, step, {_TURN}, {", ".join(f"a{i}0*x+a{i}1*y+a{i}2*z+{t} AS e{4 * i + 4}" for i, t in enumerate(("tx", "ty", "tz")))}, fx, cy, step/11.0::DOUBLE AS time
 FROM (SELECT *, b1*r2-b2*r1 AS u0, b2*r0-b0*r2 AS u1, b0*r1-b1*r0 AS u2 FROM (SELECT *, s0/n AS r0, s1/n AS r1, s2/n AS r2 FROM (SELECT *, sqrt(s0*s0+s1*s1+s2*s2) AS n
 FROM (SELECT *, a12*b2-a22*b1 AS s0, a22*b0-a02*b2 AS s1, a02*b1-a12*b0 AS s2 FROM (SELECT *, x/m AS b0, y/m AS b1, (z+f)/m AS b2 FROM (SELECT *, sqrt(x*x+y*y+(z+f)*(z+f)) AS m
 FROM (SELECT p.*, fx, cy, least(fx, fy) AS f, step, 0.5::DOUBLE*cos(step*pi()/3) AS x, -0.4::DOUBLE*sin(step*pi()/3) AS y, -0.3::DOUBLE*sin(step*pi()/6) AS z
 FROM (SELECT * FROM {POSE} QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY frame_id) = 1) p JOIN cameras USING (scene_id, camera_id), (SELECT CAST(unnest(range(12)) AS INTEGER) AS step) k)))))))""")


def _imported(frames):
    y, p = F.col("yaw") / 2, F.col("pitch") / 2
    q = F.array(F.cos(y) * F.cos(p), -F.sin(y) * F.sin(p), F.cos(y) * F.sin(p), F.sin(y) * F.cos(p))
    return frames.select("frame_id", q.alias("qvec"), F.array("tx", "ty", "tz").alias("tvec"))


_BACK = [f"-(a0{k}*tx+a1{k}*ty+a2{k}*tz)" for k in range(3)]
_ROWS = [[f"a0{k}", f"-a1{k}", f"-a2{k}", _BACK[k]] for k in range(3)]
for _name, _keep, _rows in (("p02_sfm_to_c2w", True, _ROWS), ("p02_sfm_to_c2w_upright", False, [_ROWS[0], _ROWS[2], [f"-({x})" for x in _ROWS[1]]])):
    add(_name, "frames", lambda f, k=_keep: _parts(scenes.sfm_to_c2w(_imported(f), k), "frame_id"), "frame_id", _E,
        "SELECT frame_id, " + ", ".join(f"{x} AS e{n}" for n, x in enumerate((x for row in _rows for x in row), 1)) + f" FROM {POSE}")

_BOX = "(SELECT scene_id, " + ", ".join(f"min(t{c}) AS min_{c}, max(t{c}) AS max_{c}" for c in "xyz") + " FROM frames GROUP BY scene_id)"
add("p11_normalise_to_given_box", "points3d frames", lambda p, f: points.normalise_to_box(p, scenes.scene_box(f)), "scene_id point3d_id", "x y z",
    "SELECT scene_id, point3d_id, " + ", ".join(f"CASE WHEN max_{c} = min_{c} THEN {c}-min_{c} ELSE ({c}-min_{c})/nullif(max_{c}-min_{c}, 0) END AS {c}" for c in "xyz") + f" FROM points3d JOIN {_BOX} USING (scene_id)")
_SIX = " ".join(f"{n}_{c}" for n in ("min", "max") for c in "xyz")
add("p11_recentred_box", "frames", lambda f: scenes.recentred_box(scenes.scene_box(f), 1.5), "scene_id", _SIX,
    "SELECT scene_id, " + ", ".join(f"{s}(max_{c}-min_{c})*0.75::DOUBLE AS {n}_{c}" for n, s in (("min", "-"), ("max", "")) for c in "xyz") + f" FROM {_BOX}")
add("p12_splat_rgb", "points3d", lambda p: points.splat_rgb(points.splat_colors(p).drop("r", "g", "b")), "scene_id point3d_id r g b", "alpha", "SELECT scene_id, point3d_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, 0.1::DOUBLE AS alpha FROM points3d")
add("p14_distance_to_depth", "pixels cameras", lambda p, c: rays.distance_to_depth(p, c, "depth_pred"), "scene_id image_id y x", "depth",
    "SELECT scene_id, image_id, y, x, depth_pred/sqrt(pow((x+0.5::DOUBLE-cx)/fx, 2)+pow((y+0.5::DOUBLE-cy)/fy, 2)+1) AS depth FROM pixels JOIN cameras USING (scene_id, camera_id)")
add("p19_blend_depth", "pixels", lambda p: pixels.normalise_depth(p, 1.0, 6.0, "pred"), "scene_id image_id y x", "value",
    "SELECT scene_id, image_id, y, x, least(greatest((depth_pred-1)/(5+1e-10::DOUBLE), 0), 1)*pred+(1-pred) AS value FROM pixels")
add("w12_merged_bins", "ray_samples", lambda s: rays.merged_bins(s, 4), "scene_id ray_id sample_idx", "t_start t_end",
    f"""SELECT scene_id, ray_id, CAST(row_number() OVER w - 1 AS INTEGER) AS sample_idx, t AS t_start, lead(t) OVER w AS t_end FROM (SELECT scene_id, ray_id, t_start AS t FROM ray_samples
 UNION ALL SELECT scene_id, ray_id, max(t_start+delta) FROM ray_samples GROUP BY ALL
 UNION ALL SELECT scene_id, ray_id, t_start+delta*(u-lo)/(hi-lo) FROM (SELECT *, (k+0.5::DOUBLE)/4 AS u FROM (SELECT *, coalesce(sum(p) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/sum(p) OVER (PARTITION BY scene_id, ray_id) AS lo, sum(p) OVER (o ROWS UNBOUNDED PRECEDING)/sum(p) OVER (PARTITION BY scene_id, ray_id) AS hi FROM (SELECT *, weight+0.01 AS p FROM {WEIGHTS}) WINDOW o AS (PARTITION BY scene_id, ray_id ORDER BY sample_idx)), (SELECT unnest(range(4)) AS k) q) WHERE u >= lo AND u < hi)
 WINDOW w AS (PARTITION BY scene_id, ray_id ORDER BY t) QUALIFY lead(t) OVER w IS NOT NULL""")
