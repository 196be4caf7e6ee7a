"""Registered capture queries over the derived tables, each with a SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark import shared
from capture_spark.fixtures import view, with_views
from capture_spark.operators import joins, pixels, points, rays, scenes, telemetry
from capture_spark.streaming import telemetry as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, views: str, build: Callable[..., DataFrame], keys: str, doubles: str, sql: str) -> None:
    """Register a query over views; ``doubles`` are rounded to six places on both sides."""
    keep, real = keys.split(), doubles.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(*[view(spark, sf_dir, v) for v in views.split()])
        six = {c: F.round(F.col(c), 6) for c in real}
        return out.select(*keep, *[F.when(x == 0, 0.0).otherwise(x).alias(c) for c, x in six.items()])

    QUERIES[name] = run
    columns = ", ".join([*keep, *[f"CASE WHEN round({c}, 6) = 0 THEN 0.0::DOUBLE ELSE round({c}, 6) END AS {c}" for c in real]])
    ORACLES[name] = with_views(f"SELECT {columns} FROM ({sql}) final")


POSE = """(SELECT *, cos(yaw)*cos(pitch) AS a00, -sin(yaw) AS a01, cos(yaw)*sin(pitch) AS a02, sin(yaw)*cos(pitch) AS a10, cos(yaw) AS a11, sin(yaw)*sin(pitch) AS a12,
 -sin(pitch) AS a20, 0.0::DOUBLE AS a21, cos(pitch) AS a22 FROM frames)"""
CENTRED = """(SELECT f.*, cx, cy, cz, u0/n AS e0, u1/n AS e1, u2/n AS e2 FROM frames f JOIN (SELECT *, sqrt(u0*u0+u1*u1+u2*u2) AS n FROM (SELECT scene_id, avg(tx) AS cx, avg(ty) AS cy, avg(tz) AS cz,
 avg(-sin(yaw)) AS u0, avg(cos(yaw)) AS u1, avg(0.0::DOUBLE) AS u2 FROM frames GROUP BY scene_id)) s ON s.scene_id = f.scene_id)"""
TURNED = f"""(SELECT *, (1-e0*e0/(1+e2))*(tx-cx) - e0*e1/(1+e2)*(ty-cy) - e0*(tz-cz) AS px, -e0*e1/(1+e2)*(tx-cx) + (1-e1*e1/(1+e2))*(ty-cy) - e1*(tz-cz) AS py,
 e0*(tx-cx) + e1*(ty-cy) + (1-(e0*e0+e1*e1)/(1+e2))*(tz-cz) AS pz FROM {CENTRED})"""
NORMAL = f"(SELECT *, px*s AS nx, py*s AS ny, pz*s AS nz FROM (SELECT *, 1/max(greatest(abs(px), abs(py), abs(pz))) OVER (PARTITION BY scene_id) AS s FROM {TURNED}))"
PLACED = "(SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY file_path) - 1 AS idx, count(*) OVER (PARTITION BY scene_id) AS n FROM frames)"


def _train(f: float) -> str:
    return f"""(SELECT DISTINCT scene_id, CAST(CASE WHEN j = m - 1 AND m > 1 THEN n - 1 ELSE floor(j * (CAST(n - 1 AS DOUBLE) / greatest(m - 1, 1))) END AS BIGINT) AS idx
 FROM (SELECT scene_id, n, m, unnest(range(m)) AS j FROM (SELECT scene_id, count(*) AS n, CAST(ceil(count(*) * CAST({f} AS DOUBLE)) AS BIGINT) AS m FROM frames GROUP BY scene_id)))"""


SPLIT = f"(SELECT p.*, CASE WHEN t.idx IS NULL THEN 'eval' ELSE 'train' END AS split FROM {PLACED} p LEFT JOIN {_train(0.9)} t ON t.scene_id = p.scene_id AND t.idx = p.idx)"


def _parse(frames: DataFrame) -> DataFrame:
    both = scenes.split_fraction(scenes.normalised(frames), 0.9)
    return both.groupBy("scene_id", "split").agg(F.count("*").alias("n_frames"), F.avg(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)).alias("radius"))


add("parse_scenes", "frames", _parse, "scene_id split n_frames", "radius",
    f"SELECT a.scene_id, split, count(*) AS n_frames, avg(sqrt(nx*nx+ny*ny+nz*nz)) AS radius FROM {NORMAL} a JOIN {SPLIT} b ON a.frame_id = b.frame_id GROUP BY a.scene_id, split")
add("a01_scene_center", "frames", scenes.scene_center, "scene_id n_frames", "cx cy cz", "SELECT scene_id, avg(tx) AS cx, avg(ty) AS cy, avg(tz) AS cz, count(*) AS n_frames FROM frames GROUP BY scene_id")
add("a03_a06_orient_scale", "frames", scenes.normalised, "scene_id frame_id", "nx ny nz scale", f"SELECT scene_id, frame_id, nx, ny, nz, s AS scale FROM {NORMAL}")
add("a07_scene_box", "frames", scenes.scene_box, "scene_id", "min_x min_y min_z max_x max_y max_z", "SELECT scene_id, min(tx) AS min_x, min(ty) AS min_y, min(tz) AS min_z, max(tx) AS max_x, max(ty) AS max_y, max(tz) AS max_z FROM frames GROUP BY scene_id")
add("p03_invert_pose", "frames", lambda f: scenes.with_pose(f).withColumn("p", scenes.invert(F.col("c2w"))).select("frame_id", *[F.element_at("p", k).alias(f"e{k}") for k in (1, 2, 4, 8, 12)]), "frame_id", "e1 e2 e4 e8 e12",
    f"SELECT frame_id, a00 AS e1, a10 AS e2, -(a00*tx+a10*ty+a20*tz) AS e4, -(a01*tx+a11*ty+a21*tz) AS e8, -(a02*tx+a12*ty+a22*tz) AS e12 FROM {POSE}")
add("p02_camera_axes", "frames", lambda f: scenes.with_pose(f).withColumn("p", scenes.to_camera_convention(F.col("c2w"))).select("frame_id", *[F.element_at("p", k).alias(f"e{k}") for k in (1, 2, 3, 4, 11)]), "frame_id", "e1 e2 e3 e4 e11",
    f"SELECT frame_id, a00 AS e1, -a01 AS e2, -a02 AS e3, tx AS e4, -a22 AS e11 FROM {POSE}")
for _mode, _side in (("floor", "floor(s*0.3::DOUBLE)"), ("round", "floor(s*0.3::DOUBLE+0.5)"), ("ceil", "ceil(s*0.3::DOUBLE)")):
    add(f"p05_rescale_{_mode}", "frames cameras", lambda f, c, m=_mode: f.join(scenes.rescale(c, 0.3, m), ["scene_id", "camera_id"]), "frame_id width height", "fx cx",
        f"SELECT frame_id, CAST({_side.replace('s*', 'width*')} AS INTEGER) AS width, CAST({_side.replace('s*', 'height*')} AS INTEGER) AS height, fx*0.3::DOUBLE AS fx, cx*0.3::DOUBLE AS cx FROM frames JOIN cameras USING (scene_id, camera_id)")
add("p06_tile_frames", "cameras", lambda c: scenes.tile_frames(c, 2), "scene_id camera_id tile width height", "cx cy",
    "SELECT scene_id, camera_id, tile, CAST(width // 2 + CASE WHEN tile % 2 < width % 2 THEN 1 ELSE 0 END AS INTEGER) AS width, CAST(height // 2 + CASE WHEN tile // 2 < height % 2 THEN 1 ELSE 0 END AS INTEGER) AS height, cx - (width // 2 * (tile % 2) + least(tile % 2, width % 2)) AS cx, cy - (height // 2 * (tile // 2) + least(tile // 2, height % 2)) AS cy FROM cameras, (SELECT CAST(unnest(range(4)) AS INTEGER) AS tile) t")
add("p08_pixels_to_rays", "pixels cameras", rays.pixels_to_rays, "scene_id image_id y x", "dx dy dz norm",
    "SELECT scene_id, image_id, y, x, a/n AS dx, b/n AS dy, -1/n AS dz, n AS norm FROM (SELECT *, sqrt(a*a+b*b+1) AS n FROM (SELECT scene_id, image_id, y, x, (x+0.5::DOUBLE-cx)/fx AS a, -(y+0.5::DOUBLE-cy)/fy AS b FROM pixels JOIN cameras USING (scene_id, camera_id)))")
for _o, _n in (("l2", "sqrt(x*x+y*y+z*z)"), ("linf", "greatest(abs(x), abs(y), abs(z))")):
    add(f"p10_contract_{_o}", "points3d", lambda p, o=_o: points.contract(p, o), "scene_id point3d_id", "x y z", f"SELECT scene_id, point3d_id, x*k AS x, y*k AS y, z*k AS z FROM (SELECT *, CASE WHEN {_n} < 1 THEN 1 ELSE (2-1/{_n})/{_n} END AS k FROM points3d)")
add("p11_normalise_to_box", "points3d", points.normalise_to_box, "scene_id point3d_id", "x y z", "SELECT scene_id, point3d_id, " + ", ".join(f"({c}-min({c}) OVER w)/(max({c}) OVER w-min({c}) OVER w) AS {c}" for c in "xyz") + " FROM points3d WINDOW w AS (PARTITION BY scene_id)")
add("p12_splat_colors", "points3d", points.splat_colors, "scene_id point3d_id", "f_dc_0 f_dc_1 f_dc_2 opacity", "SELECT scene_id, point3d_id, " + ", ".join(f"({c}/255.0::DOUBLE-0.5)/0.28209479177387814::DOUBLE AS f_dc_{i}" for i, c in enumerate("rgb")) + ", ln(0.1::DOUBLE/0.9::DOUBLE) AS opacity FROM points3d")
add("p14_depth_to_distance", "pixels cameras", rays.depth_to_distance, "scene_id image_id y x", "distance",
    "SELECT scene_id, image_id, y, x, depth_gt*sqrt(pow((x+0.5::DOUBLE-cx)/fx, 2)+pow((y+0.5::DOUBLE-cy)/fy, 2)+1) AS distance FROM pixels JOIN cameras USING (scene_id, camera_id)")
add("p17_image_pyramid", "pixels", lambda p: pixels.image_pyramid(p, 3), "scene_id image_id level py px", "value", "SELECT scene_id, image_id, level, CAST(floor(y/pow(2, level)) AS BIGINT) AS py, CAST(floor(x/pow(2, level)) AS BIGINT) AS px, avg(gt) AS value FROM pixels, (SELECT CAST(unnest(range(3)) AS INTEGER) AS level) l GROUP BY ALL")
add("p19_normalise_depth", "pixels", pixels.normalise_depth, "scene_id image_id y x bin", "value", "SELECT *, CAST(floor(value*255) AS BIGINT) AS bin FROM (SELECT scene_id, image_id, y, x, least(greatest((depth_pred-min(depth_pred) OVER w)/(max(depth_pred) OVER w-min(depth_pred) OVER w+1e-10::DOUBLE), 0), 1) AS value FROM pixels WINDOW w AS (PARTITION BY scene_id, image_id))")
add("p20_derive_paths", "frames", scenes.derive_paths, "frame_id mask_path depth_path", "", "SELECT frame_id, regexp_replace(file_path, '^images/', 'masks/') AS mask_path, regexp_replace(regexp_replace(file_path, '^images/', 'depth/'), '\\.png$', '.npy') AS depth_path FROM frames")
add("p21_spiral_path", "frames", lambda f: scenes.spiral_path(f, 12, 0.5, 2.0, 0.5), "scene_id step", "x y z",
    "SELECT scene_id, step, tx+0.5::DOUBLE*cos(step*pi()/3) AS x, ty-0.5::DOUBLE*sin(step*pi()/3) AS y, tz-0.5::DOUBLE*sin(step*pi()/6) AS z FROM (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY frame_id) = 1), (SELECT CAST(unnest(range(12)) AS INTEGER) AS step) s")
add("f01_within_aabb", "points3d", lambda p: points.within_aabb(p, (-5, -5, -5), (5, 5, 5)), "scene_id point3d_id", "", "SELECT scene_id, point3d_id FROM points3d WHERE x > -5 AND x < 5 AND y > -5 AND y < 5 AND z > -5 AND z < 5")
for _m, _t, _c in (("round", "round_even", "n > 40"), ("trunc", "floor", "n >= 40")):
    add(f"f0{5 + (_m == 'trunc')}_even_subsample_{_m}", "frames", lambda f, m=_m: scenes.even_subsample(f, 40, m), "scene_id frame_id", "",
        f"SELECT scene_id, frame_id FROM {PLACED} p WHERE NOT ({_c}) OR idx IN (SELECT CAST(CASE WHEN j = 39 THEN n - 1 ELSE {'round_even(j*(CAST(n-1 AS DOUBLE)/39), 0)' if _m == 'round' else 'floor(j*(CAST(n-1 AS DOUBLE)/39))'} END AS BIGINT) FROM (SELECT unnest(range(40)) AS j))")
add("f07_select_frames", "frames", lambda f: scenes.select_frames(f, 30), "scene_id frame_id", "", f"SELECT scene_id, frame_id FROM {PLACED} WHERE n <= 30 OR (idx % greatest(n // 30, 1) = 0 AND idx // greatest(n // 30, 1) < 30)")
add("f08_blur_summary", "frames", lambda f: scenes.blur_summary(f, 30.0), "scene_id skipped kept", "", "SELECT scene_id, count(*) FILTER (WHERE coalesce(blur_score < 30, false)) AS skipped, count(*) FILTER (WHERE NOT coalesce(blur_score < 30, false)) AS kept FROM frames GROUP BY scene_id")
add("s13_filter_blur", "frames", lambda f: scenes.filter_blur(f, 30.0), "frame_id", "blur_score", "SELECT frame_id, blur_score FROM frames WHERE blur_score IS NULL OR blur_score >= 30")
add("f10_semantic_mask", "pixels", lambda p: pixels.semantic_mask(p, p.select("class_id").distinct().filter("class_id IN (2, 5)")), "scene_id image_id y x class_id", "", "SELECT scene_id, image_id, y, x, class_id FROM pixels WHERE mask AND class_id NOT IN (2, 5)")
add("f14_apply_mask_color", "pixels", lambda p: pixels.apply_mask_color(p, 0.5), "scene_id image_id y x", "gt", "SELECT scene_id, image_id, y, x, CASE WHEN mask THEN gt ELSE 0.5 END AS gt FROM pixels")
add("j01_image_camera", "frames cameras", lambda f, c: f.join(c, ["scene_id", "camera_id"]), "frame_id camera_id width height", "fx fy", "SELECT frame_id, camera_id, width, height, fx, fy FROM frames JOIN cameras USING (scene_id, camera_id)")
add("j02_observation_point", "observations points3d", lambda o, p: o.join(p, ["scene_id", "point3d_id"]), "scene_id image_id point2d_idx point3d_id", "x y z", "SELECT scene_id, image_id, point2d_idx, point3d_id, x, y, z FROM observations JOIN points3d USING (scene_id, point3d_id)")
add("j08_asof_forward", "captures_t poses_t", joins.asof_forward, "scene_id capture_id pose_id", "",
    "SELECT c.scene_id, c.capture_id, coalesce(p.pose_id, l.pose_id) AS pose_id FROM captures_t c ASOF LEFT JOIN poses_t p ON c.scene_id = p.scene_id AND p.pose_ts >= c.capture_ts LEFT JOIN (SELECT scene_id, arg_max(pose_id, pose_ts) AS pose_id FROM poses_t GROUP BY scene_id) l ON l.scene_id = c.scene_id")
add("j09_band_join", "captures_t poses_t", lambda c, p: joins.band_join(c, p, 600.0), "scene_id capture_id pose_id", "",
    "SELECT c.scene_id, capture_id, max(pose_id) AS pose_id FROM captures_t c JOIN poses_t p ON c.scene_id = p.scene_id AND abs(epoch_us(capture_ts) - epoch_us(pose_ts)) < 600000000 GROUP BY c.scene_id, capture_id")
add("j13_ray_box", "rays", lambda r: rays.ray_box(r, (-5, -5, -5), (5, 5, 5)), "scene_id ray_id", "near far",
    "SELECT scene_id, ray_id, CASE WHEN f >= n THEN n ELSE 1e10 END AS near, CASE WHEN f >= n THEN f ELSE 1e10 END AS far FROM (SELECT scene_id, ray_id, greatest(least(x0, x1), least(y0, y1), least(z0, z1), 0) AS n, least(greatest(x0, x1), greatest(y0, y1), greatest(z0, z1), 1e10) AS f FROM (SELECT scene_id, ray_id, " + ", ".join(f"({v}-o{c})*(CASE WHEN d{c} = 0 THEN 1e30::DOUBLE ELSE 1/d{c} END) AS {c}{k}" for c in "xyz" for k, v in ((0, -5), (1, 5))) + " FROM rays))")
add("j14_ray_sphere", "rays", lambda r: rays.ray_sphere(r, 6.0), "scene_id ray_id", "near far", "SELECT scene_id, ray_id, greatest(-b-sqrt(b*b-c), 0) AS near, greatest(-b+sqrt(b*b-c), 0) AS far FROM (SELECT scene_id, ray_id, ox*dx+oy*dy+oz*dz AS b, ox*ox+oy*oy+oz*oz-36 AS c FROM rays) WHERE b*b-c >= 0")
KNN = "(SELECT scene_id, point3d_id, other_id, distance, row_number() OVER (PARTITION BY scene_id, point3d_id ORDER BY distance, other_id) AS rank FROM (SELECT a.scene_id, a.point3d_id, b.point3d_id AS other_id, sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)+pow(a.z-b.z, 2)) AS distance FROM points3d a JOIN points3d b ON a.scene_id = b.scene_id AND a.point3d_id <> b.point3d_id))"
add("j15_nearest", "points3d", lambda p: points.nearest(p, 3).groupBy("scene_id", "point3d_id").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")), "scene_id point3d_id n", "mean", f"SELECT scene_id, point3d_id, count(*) AS n, avg(distance) AS mean FROM {KNN} WHERE rank <= 3 GROUP BY scene_id, point3d_id")
add("a13_remove_outliers", "points3d", lambda p: points.remove_outliers(p, 5, 1.0), "scene_id point3d_id", "", f"SELECT scene_id, point3d_id FROM (SELECT scene_id, point3d_id, avg(distance) AS d FROM {KNN} WHERE rank <= 5 GROUP BY scene_id, point3d_id) QUALIFY d <= avg(d) OVER (PARTITION BY scene_id) + stddev_samp(d) OVER (PARTITION BY scene_id)")
add("j18_dynamic_instances", "annotations", lambda a: joins.dynamic_instances(a, 0.98), "instance_id dynamic", "", "SELECT instance_id, bool_or(isnan(speed) OR NOT speed < 0.98) AS dynamic FROM annotations GROUP BY instance_id")
add("a11_voxel_downsample", "points3d", lambda p: points.voxel_downsample(p, 2.0), "scene_id ix iy iz n", "x y z r g b", "SELECT scene_id, CAST(floor(x/2) AS BIGINT) AS ix, CAST(floor(y/2) AS BIGINT) AS iy, CAST(floor(z/2) AS BIGINT) AS iz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM points3d GROUP BY 1, 2, 3, 4")
add("a12_dedup_points", "points3d", points.dedup_points, "scene_id point3d_id", "x y z", "SELECT scene_id, min(point3d_id) AS point3d_id, x, y, z FROM points3d GROUP BY scene_id, x, y, z")
add("a16_fuse_tsdf", "hits", points.fuse_tsdf, "scene_id voxel_id n", "value", "SELECT scene_id, voxel_id, sum(tsdf*pow(2.0::DOUBLE, -CASE WHEN k = 1 THEN n-1 ELSE n-k+1 END)) AS value, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, voxel_id ORDER BY view_order) AS k, count(*) OVER (PARTITION BY scene_id, voxel_id) AS n FROM hits) GROUP BY scene_id, voxel_id")
add("a20_grid_update", "points3d", lambda p: points.grid_update(p.filter("r < 128").groupBy((F.col("point3d_id") % 100).alias("voxel_id")).agg(F.max("g").alias("level")), p.filter("r >= 100").select((F.col("point3d_id") % 120).alias("voxel_id"), F.col("b").alias("level"))), "voxel_id level", "",
    "SELECT coalesce(o.voxel_id, n.voxel_id) AS voxel_id, greatest(o.level, n.level) AS level FROM (SELECT point3d_id % 100 AS voxel_id, max(g) AS level FROM points3d WHERE r < 128 GROUP BY 1) o FULL JOIN (SELECT point3d_id % 120 AS voxel_id, max(b) AS level FROM points3d WHERE r >= 100 GROUP BY 1) n ON o.voxel_id = n.voxel_id")
add("a22_image_metrics", "pixels", pixels.image_metrics, "scene_id image_id", "mse l1 masked_mse psnr", "SELECT scene_id, image_id, avg(pow(gt-pred, 2)) AS mse, avg(abs(gt-pred)) AS l1, avg(pow(gt-pred, 2)) FILTER (WHERE mask) AS masked_mse, CASE WHEN avg(pow(gt-pred, 2)) = 0 THEN CAST('inf' AS DOUBLE) ELSE -10*log10(avg(pow(gt-pred, 2))) END AS psnr FROM pixels GROUP BY scene_id, image_id")
add("a24_depth_mse", "pixels", pixels.depth_mse, "scene_id image_id valid", "depth_mse", "SELECT scene_id, image_id, count(*) AS valid, avg(pow(depth_gt-depth_pred, 2)) AS depth_mse FROM pixels WHERE depth_gt > 0 GROUP BY scene_id, image_id")
ALIGN = "(SELECT scene_id, image_id, (n*c-b*d)/(a*n-b*b) AS scale, (a*d-b*c)/(a*n-b*b) AS shift FROM (SELECT scene_id, image_id, sum(depth_pred*depth_pred) AS a, sum(depth_pred) AS b, CAST(count(*) AS DOUBLE) AS n, sum(depth_pred*depth_gt) AS c, sum(depth_gt) AS d FROM pixels WHERE depth_gt > 0 GROUP BY scene_id, image_id))"
add("a26_align_depth", "pixels", pixels.align_depth, "scene_id image_id", "scale shift", f"SELECT * FROM {ALIGN}")
add("a27_ssi_mse", "pixels", pixels.ssi_mse, "scene_id image_id", "ssi_mse", f"SELECT scene_id, image_id, avg(pow(scale*depth_pred+shift-depth_gt, 2)) AS ssi_mse FROM pixels JOIN {ALIGN} USING (scene_id, image_id) WHERE depth_gt > 0 GROUP BY scene_id, image_id")
add("a29_total_variation", "pixels", pixels.total_variation, "scene_id image_id", "tv", "SELECT scene_id, image_id, 2*(avg(pow(gt-l, 2))+avg(pow(gt-u, 2))) AS tv FROM (SELECT *, lag(gt) OVER (PARTITION BY scene_id, image_id, y ORDER BY x) AS l, lag(gt) OVER (PARTITION BY scene_id, image_id, x ORDER BY y) AS u FROM pixels) GROUP BY scene_id, image_id")
WEIGHTS = "(SELECT *, alpha*trans AS weight, t_start+delta/2 AS mid FROM (SELECT *, 1-exp(-delta*density) AS alpha, exp(-coalesce(sum(delta*density) OVER (PARTITION BY scene_id, ray_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS trans FROM ray_samples))"
add("w01_ray_weights", "ray_samples", rays.ray_weights, "scene_id ray_id sample_idx", "alpha transmittance weight", f"SELECT scene_id, ray_id, sample_idx, alpha, trans AS transmittance, weight FROM {WEIGHTS}")
add("w02_alpha_weights", "ray_samples", rays.alpha_weights, "scene_id ray_id sample_idx", "transmittance weight", "SELECT scene_id, ray_id, sample_idx, t AS transmittance, a*t AS weight FROM (SELECT *, exp(coalesce(sum(ln(1-a+1e-7)) OVER (PARTITION BY scene_id, ray_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t FROM (SELECT *, 1-exp(-delta*density) AS a FROM ray_samples))")
add("w03_composite", "ray_samples", rays.composite, "scene_id ray_id", "r g b accumulation", f"SELECT scene_id, ray_id, sum(weight*r) AS r, sum(weight*g) AS g, sum(weight*b) AS b, sum(weight) AS accumulation FROM {WEIGHTS} GROUP BY scene_id, ray_id")
add("w03_composite_last", "ray_samples", lambda s: rays.composite(s, "last"), "scene_id ray_id", "r accumulation", f"SELECT scene_id, ray_id, sum(weight*r)+arg_max(r, sample_idx)*(1-sum(weight)) AS r, sum(weight) AS accumulation FROM {WEIGHTS} GROUP BY scene_id, ray_id")
add("w04_depth_median", "ray_samples", rays.depth_median, "scene_id ray_id", "depth", f"SELECT scene_id, ray_id, coalesce(min(mid) FILTER (WHERE s >= 0.5), max(mid)) AS depth FROM (SELECT *, sum(weight) OVER (PARTITION BY scene_id, ray_id ORDER BY sample_idx) AS s FROM {WEIGHTS}) GROUP BY scene_id, ray_id")
add("w05_depth_expected", "ray_samples", rays.depth_expected, "scene_id ray_id", "depth", f"SELECT scene_id, ray_id, greatest(least(sum(weight*mid)/(sum(weight)+1e-10), (SELECT max(t_start+delta/2) FROM ray_samples)), (SELECT min(t_start+delta/2) FROM ray_samples)) AS depth FROM {WEIGHTS} GROUP BY scene_id, ray_id")
add("w06_composite_channel", "ray_samples", lambda s: rays.composite_channel(s, "density"), "scene_id ray_id", "value", f"SELECT scene_id, ray_id, sum(weight*density) AS value FROM {WEIGHTS} GROUP BY scene_id, ray_id")
add("w07_ray_distortion", "ray_samples", rays.ray_distortion, "scene_id ray_id", "distortion", f"SELECT a.scene_id, a.ray_id, p+q AS distortion FROM (SELECT x.scene_id, x.ray_id, sum(x.weight*y.weight*abs(x.mid-y.mid)) AS p FROM {WEIGHTS} x JOIN {WEIGHTS} y ON x.scene_id = y.scene_id AND x.ray_id = y.ray_id GROUP BY x.scene_id, x.ray_id) a JOIN (SELECT scene_id, ray_id, sum(weight*weight*delta)/3 AS q FROM {WEIGHTS} GROUP BY scene_id, ray_id) b ON a.scene_id = b.scene_id AND a.ray_id = b.ray_id")
add("j20_interval_envelope", "ray_samples", lambda s: rays.interval_envelope(s, rays.ray_weights(s).withColumn("t_start", F.col("t_start") + 0.2)), "scene_id ray_id sample_idx", "bound", f"SELECT t.scene_id, t.ray_id, t.sample_idx, sum(e.weight) AS bound FROM ray_samples t JOIN {WEIGHTS} e ON t.scene_id = e.scene_id AND t.ray_id = e.ray_id AND e.t_start+0.2 < t.t_start+t.delta AND e.t_start+0.2+e.delta > t.t_start GROUP BY t.scene_id, t.ray_id, t.sample_idx")
add("w09_depth_supervision", "ray_samples", lambda s: rays.depth_supervision(s, s.groupBy("scene_id", "ray_id").agg(F.max("t_start").alias("depth")), 0.1), "scene_id ray_id", "loss", f"SELECT w.scene_id, w.ray_id, sum(-ln(weight+1e-7)*exp(-pow(mid-depth, 2)/0.2)*delta) AS loss FROM {WEIGHTS} w JOIN (SELECT scene_id, ray_id, max(t_start) AS depth FROM ray_samples GROUP BY scene_id, ray_id) d ON d.scene_id = w.scene_id AND d.ray_id = w.ray_id GROUP BY w.scene_id, w.ray_id")
for _s, _a in (("uniform", "2+4*k/8.0::DOUBLE"), ("inverse", "1/(0.5::DOUBLE+(1/6.0::DOUBLE-0.5)*k/8)"), ("sqrt", "pow(sqrt(2.0)+(sqrt(6.0)-sqrt(2.0))*k/8, 2)"), ("log", "exp(ln(2.0)+(ln(6.0)-ln(2.0))*k/8)")):
    add(f"w11_sample_rays_{_s}", "rays", lambda r, s=_s: rays.sample_rays(r, 8, 2.0, 6.0, s), "scene_id ray_id sample_idx", "t_start t_end", f"SELECT scene_id, ray_id, k AS sample_idx, {_a} AS t_start, {_a.replace('k/8', '(k+1)/8')} AS t_end FROM rays, (SELECT CAST(unnest(range(8)) AS INTEGER) AS k) s")
add("w12_resample_pdf", "ray_samples", lambda s: rays.resample_pdf(s, 4), "scene_id ray_id k", "t",
    f"SELECT scene_id, ray_id, k, t_start+delta*(u-lo)/(hi-lo) AS t FROM (SELECT *, (k+0.5::DOUBLE)/4 AS u FROM (SELECT *, coalesce(sum(p) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/sum(p) OVER (PARTITION BY scene_id, ray_id) AS lo, sum(p) OVER (o ROWS UNBOUNDED PRECEDING)/sum(p) OVER (PARTITION BY scene_id, ray_id) AS hi FROM (SELECT *, weight+0.01 AS p FROM {WEIGHTS}) WINDOW o AS (PARTITION BY scene_id, ray_id ORDER BY sample_idx)), (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) q) WHERE u >= lo AND u < hi")
add("w15_moving_avg", "telemetry", telemetry.moving_avg, "run_id name step", "avg", "SELECT run_id, name, step, avg(value) OVER (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg FROM telemetry")
add("w17_depth_ranking", "pixels", pixels.depth_ranking, "scene_id image_id", "penalty",
    "SELECT scene_id, image_id, avg(CASE WHEN sign(t)*sign(q) < 0 THEN abs(q) WHEN t IS NOT NULL THEN 0 END) AS penalty FROM (SELECT scene_id, image_id, y, x // 2 AS p, max(depth_gt) FILTER (WHERE x % 2 = 0)-max(depth_gt) FILTER (WHERE x % 2 = 1) AS t, max(depth_pred) FILTER (WHERE x % 2 = 0)-max(depth_pred) FILTER (WHERE x % 2 = 1) AS q FROM pixels GROUP BY 1, 2, 3, 4) GROUP BY scene_id, image_id")
add("a25_eval_report", "telemetry", telemetry.eval_report, "run_id name n", "mean std", "SELECT run_id, name, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM telemetry GROUP BY run_id, name")
add("a33_profile", "telemetry", telemetry.profile, "name calls", "mean", "SELECT name, count(*) AS calls, avg(value) AS mean FROM telemetry GROUP BY name")
add("k01_split_fraction", "frames", lambda f: scenes.split_fraction(f, 0.9), "scene_id frame_id split", "", f"SELECT scene_id, frame_id, split FROM {SPLIT}")
add("k02_split_filename", "frames", scenes.split_filename, "frame_id split", "", "SELECT frame_id, CASE WHEN contains(file_path, 'train') THEN 'train' ELSE 'eval' END AS split FROM frames")
add("k03_split_interval", "frames", lambda f: scenes.split_interval(f, 8), "frame_id split", "", f"SELECT frame_id, CASE WHEN idx % 8 = 0 THEN 'eval' ELSE 'train' END AS split FROM {PLACED}")
add("k04_split_all", "frames", scenes.split_all, "frame_id split", "", "SELECT frame_id, unnest(['train', 'eval']) AS split FROM frames")
add("k06_split_rig", "frames", lambda f: scenes.split_rig(f, 0.8, F.floor(F.col("frame_id") / 100)), "frame_id split", "",
    f"SELECT frame_id, CASE WHEN t.idx IS NULL THEN 'eval' ELSE 'train' END AS split FROM frames f JOIN (SELECT scene_id, sample, row_number() OVER (PARTITION BY scene_id ORDER BY sample) - 1 AS idx FROM (SELECT DISTINCT scene_id, frame_id // 100 AS sample FROM frames)) s ON s.scene_id = f.scene_id AND s.sample = f.frame_id // 100 LEFT JOIN {_train(0.8).replace('FROM frames', 'FROM (SELECT DISTINCT scene_id, frame_id // 100 AS sample FROM frames)')} t ON t.scene_id = s.scene_id AND t.idx = s.idx")
add("k13_divide_budget", "frames", lambda f: scenes.divide_budget(f, 4096), "frame_id rays", "", f"SELECT frame_id, CASE WHEN idx = n - 1 THEN 4096 - 4096 // n * (n - 1) ELSE 4096 // n END AS rays FROM {PLACED}")
add("k17_erode_mask", "pixels", lambda p: pixels.erode_mask(p, 1), "scene_id image_id y x mask", "", "SELECT p.scene_id, p.image_id, p.y, p.x, count(*) FILTER (WHERE q.mask) = 9 AS mask FROM pixels p JOIN pixels q ON p.scene_id = q.scene_id AND p.image_id = q.image_id AND abs(p.x-q.x) <= 1 AND abs(p.y-q.y) <= 1 GROUP BY 1, 2, 3, 4")
add("k18_latest_checkpoint", "frames", scenes.latest_checkpoint, "scene_id file_path step", "", "SELECT scene_id, arg_max(file_path, frame_id) AS file_path, max(frame_id) AS step FROM frames GROUP BY scene_id")
add("k19_every_nth", "frames", lambda f: scenes.placed(f).filter("idx % 7 = 0"), "scene_id frame_id", "", f"SELECT scene_id, frame_id FROM {PLACED} WHERE idx % 7 = 0")
add("t05_camera_variety", "frames", lambda f: scenes.camera_variety(f, 1), "scene_id cameras", "", "SELECT scene_id, count(DISTINCT camera_id) AS cameras FROM frames GROUP BY scene_id HAVING count(DISTINCT camera_id) > 1")


def _streamed(name: str, build: Callable[[DataFrame], DataFrame], mode: str, result: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A streaming query run over the events at hand; its batches are a Parquet table in the shared folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = f"{sf_dir}/events.parquet"
        # A stream reads folders; the events are copied into one if they are a single file.
        events = spark.read.parquet(path)
        events.write.parquet(f"{folder}/in")
        out = build(live.ingest(spark, f"{folder}/in", events.schema, 2))
        live.drain(out, mode, f"{folder}/log", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out"))
        return result(spark.read.parquet(f"{folder}/out"))

    QUERIES[name] = run
    ORACLES[name] = sql


def _final(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    def pick(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, "batch")]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])

    return pick


_streamed("x04_latest_board", lambda e: live.latest(e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "event_id", "value")), "update", _final(["run_id", "name"]),
          "SELECT user_id AS run_id, event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
_streamed("x07_voxel_max", lambda e: live.voxel_max(e.select((F.col("event_id") % 50).alias("voxel_id"), F.col("user_id").alias("level"))), "update", _final(["voxel_id"]), "SELECT event_id % 50 AS voxel_id, max(user_id) AS level FROM events GROUP BY 1")
_streamed("x08_gated_events", lambda e: live.gated(e.select(F.col("event_id").alias("step"), "value"), 10), "append", lambda df: df.drop("batch"), "SELECT event_id AS step, value FROM events WHERE event_id % 10 = 0")
