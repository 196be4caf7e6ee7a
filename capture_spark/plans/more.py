"""Registered queries over posed images, cameras, samples and streams; SQL twins where SQL can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark import shared
from capture_spark.fixtures import view
from capture_spark.operators import cameras, hooks, joins, pixels, points, rays, sampling, scenes, telemetry
from capture_spark.plans.captures import ORACLES, PLACED, POSE, QUERIES, SPLIT, WEIGHTS, add
from capture_spark.streaming import telemetry as live


def images(frames: DataFrame, cams: DataFrame) -> DataFrame:
    """Frames or shots with pose and intrinsics, by image."""
    f = scenes.with_pose(frames)
    f = f.withColumn("image_id", F.col("frame_id")) if "frame_id" in f.columns else f
    return f.select("scene_id", "image_id", "camera_id", "c2w").join(cams, ["scene_id", "camera_id"])


IMAGES = f"(SELECT scene_id, frame_id AS image_id, a00, a01, a02, a10, a11, a12, a20, a21, a22, tx, ty, tz, fx, fy, cx, cy, width, height FROM {POSE} JOIN cameras USING (scene_id, camera_id))"
SHOTS = IMAGES.replace("frame_id AS image_id", "image_id").replace("FROM frames", "FROM shots")
SEEN = f"""(SELECT o.scene_id, image_id, point3d_id, point2d_idx, u, v, f2d, x, y, z, error, fx, fy, width, height, -(a02*(x-tx)+a12*(y-ty)+a22*(z-tz)) AS depth, sqrt(pow(x-tx, 2)+pow(y-ty, 2)+pow(z-tz, 2)) AS distance
 FROM observations o JOIN points3d p USING (scene_id, point3d_id) JOIN {IMAGES} i USING (scene_id, image_id))"""
CAMERA_VIEWS = "observations points3d frames cameras"


def only(name: str, views: str, build: Callable[..., DataFrame]) -> None:
    """Register a query that SQL cannot say; tests hold it against plain Python."""
    QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, v) for v in views.split()])


# Observations seen from their cameras
add("f09_usable_observations", CAMERA_VIEWS, lambda o, p, f, c: points.usable_observations(o, p, images(f, c)), "scene_id image_id point2d_idx point3d_id track", "u v depth",
    f"SELECT s.scene_id, s.image_id, s.point2d_idx, s.point3d_id, track, u, v, depth FROM {SEEN} s JOIN (SELECT scene_id, point3d_id, count(*) AS track FROM observations GROUP BY scene_id, point3d_id) t USING (scene_id, point3d_id) WHERE error <= 2.5 AND track >= 2 AND u >= 0 AND u < width AND v >= 0 AND v < height AND depth BETWEEN 0.001 AND 10000")
add("a18_sfm_depth", CAMERA_VIEWS, lambda o, p, f, c: points.sfm_depth(o, p, images(f, c)), "scene_id image_id px py depth", "",
    f"SELECT scene_id, image_id, px, py, ((CAST(trunc(d*1000) AS BIGINT) % 65536) + 65536) % 65536 AS depth FROM (SELECT scene_id, image_id, CAST(floor(u) AS BIGINT) AS px, CAST(floor(v) AS BIGINT) AS py, arg_max(depth, point2d_idx) AS d FROM {SEEN} GROUP BY 1, 2, 3, 4)")
add("a19_point_frequency", CAMERA_VIEWS, lambda o, p, f, c: points.point_frequency(o, p, images(f, c)), "scene_id point3d_id level", "f3d",
    f"SELECT *, greatest(least(CAST(round_even(ln(greatest(f3d, 1e-12))/ln(2.0::DOUBLE), 0) AS BIGINT), 7), 0) AS level FROM (SELECT scene_id, point3d_id, median(f2d*((fx+fy)/2)/(distance+1e-6)) AS f3d FROM {SEEN} GROUP BY scene_id, point3d_id)")
PATCHES = "(SELECT scene_id, image_id, y AS row, x AS col, max(gt) AS f2d FROM pixels GROUP BY 1, 2, 3, 4)"


def _patches(p: DataFrame) -> DataFrame:
    return p.groupBy("scene_id", "image_id", F.col("y").alias("row"), F.col("x").alias("col")).agg(F.max("gt").alias("f2d"))


add("j17_observed_frequency", "observations pixels frames cameras", lambda o, p, f, c: points.observed_frequency(o, _patches(p), images(f, c)), "scene_id image_id point2d_idx row col", "f2d",
    f"SELECT o.scene_id, o.image_id, o.point2d_idx, o.row, o.col, coalesce(q.f2d, 0.0::DOUBLE) AS f2d FROM (SELECT o.scene_id, o.image_id, point2d_idx, CAST(round_even(v/height*(rows-1), 0) AS BIGINT) AS row, CAST(round_even(u/width*(cols-1), 0) AS BIGINT) AS col FROM observations o JOIN {IMAGES} i USING (scene_id, image_id) LEFT JOIN (SELECT scene_id, image_id, max(row)+1 AS rows, max(col)+1 AS cols FROM {PATCHES} GROUP BY 1, 2) z USING (scene_id, image_id)) o LEFT JOIN {PATCHES} q ON q.scene_id = o.scene_id AND q.image_id = o.image_id AND q.row = o.row AND q.col = o.col")
add("j03_point_tracks", "observations", lambda o: points.point_tracks(o, 5).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("image_ids", "places")}), "scene_id point3d_id n image_ids places", "",
    "SELECT scene_id, point3d_id, CAST(count(*) AS INTEGER) AS n, array_to_string(list(CAST(image_id AS VARCHAR) ORDER BY k) || list_resize([]::VARCHAR[], 5 - count(*), '-1'), ',') AS image_ids, array_to_string(list(CAST(point2d_idx AS VARCHAR) ORDER BY k) || list_resize([]::VARCHAR[], 5 - count(*), '-1'), ',') AS places FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, point3d_id ORDER BY image_id, point2d_idx) AS k FROM observations) WHERE k <= 5 GROUP BY scene_id, point3d_id")
add("a09_point_stats", "observations points3d", lambda o, p: points.point_stats(o, p), "scene_id point3d_id track", "error", "SELECT p.scene_id, p.point3d_id, coalesce(track, 0) AS track, error FROM points3d p LEFT JOIN (SELECT scene_id, point3d_id, count(*) AS track FROM observations GROUP BY 1, 2) o USING (scene_id, point3d_id)")
add("a09_scene_stats", "observations points3d", lambda o, p: points.scene_stats(points.point_stats(o, p)), "scene_id points", "mean_track mean_error", "SELECT scene_id, count(*) AS points, avg(coalesce(track, 0)) AS mean_track, avg(error) AS mean_error FROM points3d p LEFT JOIN (SELECT scene_id, point3d_id, count(*) AS track FROM observations GROUP BY 1, 2) o USING (scene_id, point3d_id) GROUP BY scene_id")
LENS = {"fx": 8.0, "fy": 8.0, "cx": 5.0, "cy": 5.0}


def _hits(p: DataFrame, f: DataFrame, c: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    voxels = p.select("scene_id", F.col("point3d_id").alias("voxel_id"), "x", "y", "z")
    depth = d.select("scene_id", "image_id", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth_gt") * 0.2).alias("depth"), F.col("gt").alias("r"), F.col("pred").alias("g"), F.col("class_id").cast("double").alias("b"))
    return voxels, points.voxel_hits(voxels, images(f, c).withColumns({k: F.lit(v) for k, v in LENS.items()}), depth, 5.0, 4.0, 5)


HITS = f"(SELECT v.scene_id, v.voxel_id, v.image_id AS view_order, greatest(least((depth_gt*0.2::DOUBLE-far)/5, 1), -1) AS tsdf, gt AS r, pred AS g, CAST(class_id AS DOUBLE) AS b FROM (SELECT *, CAST(floor(8*cam_x/cam_z+5) AS BIGINT) AS px, CAST(floor(8*cam_y/cam_z+5) AS BIGINT) AS py FROM (SELECT p.scene_id, point3d_id AS voxel_id, image_id, a00*(x-tx)+a10*(y-ty)+a20*(z-tz) AS cam_x, -(a01*(x-tx)+a11*(y-ty)+a21*(z-tz)) AS cam_y, -(a02*(x-tx)+a12*(y-ty)+a22*(z-tz)) AS cam_z, sqrt(pow(x-tx, 2)+pow(y-ty, 2)+pow(z-tz, 2)) AS far FROM points3d p JOIN {SHOTS} i ON i.scene_id = p.scene_id) WHERE far > 0 AND abs(cam_z) > 1e-9) v JOIN pixels d ON d.scene_id = v.scene_id AND d.image_id = v.image_id AND d.x = v.px AND d.y = v.py WHERE depth_gt > 0 AND depth_gt*0.2::DOUBLE-far > -5)"
add("j16_voxel_hits", "points3d shots cameras pixels", lambda *t: _hits(*t)[1], "scene_id voxel_id view_order", "tsdf", f"SELECT scene_id, voxel_id, view_order, tsdf FROM {HITS}")
add("a16_fused_grid", "points3d shots cameras pixels", lambda *t: points.fused_grid(*_hits(*t)), "scene_id voxel_id n", "value r g b",
    f"SELECT p.scene_id, p.point3d_id AS voxel_id, coalesce(n, 0) AS n, coalesce(value, -1) AS value, coalesce(f.r, 0) AS r, coalesce(f.g, 0) AS g, coalesce(f.b, 0) AS b FROM points3d p LEFT JOIN (SELECT scene_id, voxel_id, count(*) AS n, sum(tsdf*w) AS value, sum(r*w) AS r, sum(g*w) AS g, sum(b*w) AS b FROM (SELECT *, pow(2.0::DOUBLE, -CASE WHEN k = 1 THEN n-1 ELSE n-k+1 END) AS w FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, voxel_id ORDER BY view_order) AS k, count(*) OVER (PARTITION BY scene_id, voxel_id) AS n FROM {HITS})) GROUP BY 1, 2) f ON f.scene_id = p.scene_id AND f.voxel_id = p.point3d_id")
# Points
add("f02_within_obb", "points3d", lambda p: points.within_obb(p, (0.2, -0.4, 0.5), (1, 2, 0), (10, 8, 12)), "scene_id point3d_id", "",
    "SELECT scene_id, point3d_id FROM (SELECT *, cos(0.5)*dx+sin(0.5)*dy AS ex, cos(0.5)*dy-sin(0.5)*dx AS ey FROM (SELECT *, x-1 AS dx, y-2 AS dy FROM points3d)) WHERE abs(cos(0.4)*ex+sin(0.4)*z) < 5 AND abs(cos(0.2)*ey+sin(0.2)*(-sin(0.4)*ex+cos(0.4)*z)) < 4 AND abs(cos(0.2)*(-sin(0.4)*ex+cos(0.4)*z)-sin(0.2)*ey) < 6")


def _splats(p: DataFrame) -> DataFrame:
    return p.withColumns({"x": F.when(F.col("r") < 20, float("nan")).otherwise(F.col("x")), "opacity": F.when(F.col("g") < 9, float("inf")).otherwise(F.col("z") - 1)})


add("f03_clean_splats", "points3d", lambda p: points.clean_splats(_splats(p), ("x", "y", "z", "opacity")), "scene_id point3d_id", "", "SELECT scene_id, point3d_id FROM points3d WHERE r >= 20 AND g >= 9 AND z - 1 >= -5.5373")
add("f03_splat_counts", "points3d", lambda p: points.splat_counts(_splats(p), ("x", "y", "z")), "scene_id n kept not_finite faint", "", "SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE r >= 20 AND g >= 9 AND z - 1 >= -5.5373) AS kept, count(*) FILTER (WHERE r < 20 OR g < 9) AS not_finite, count(*) FILTER (WHERE r >= 20 AND g >= 9 AND z - 1 < -5.5373) AS faint FROM points3d GROUP BY scene_id")
add("f04_backproject", "rays ray_samples", lambda r, s: points.within_obb(points.backproject(r, rays.composite(s).join(rays.depth_median(s), ["scene_id", "ray_id"])), (0.0, 0.0, 0.5), (0, 0, 0), (16, 16, 16)), "scene_id ray_id", "x y z",
    f"SELECT scene_id, ray_id, x, y, z FROM (SELECT r.scene_id, r.ray_id, ox+dx*depth AS x, oy+dy*depth AS y, oz+dz*depth AS z FROM rays r JOIN (SELECT scene_id, ray_id, sum(weight) AS acc, coalesce(min(mid) FILTER (WHERE s >= 0.5), max(mid)) AS depth FROM (SELECT *, sum(weight) OVER (PARTITION BY scene_id, ray_id ORDER BY sample_idx) AS s FROM {WEIGHTS}) GROUP BY 1, 2) d ON d.scene_id = r.scene_id AND d.ray_id = r.ray_id WHERE acc > 0.5) WHERE abs(cos(0.5)*x+sin(0.5)*y) < 8 AND abs(cos(0.5)*y-sin(0.5)*x) < 8 AND abs(z) < 8")
add("a36_spatial_hash", "points3d", lambda p: points.spatial_hash(p, 4.0, 10, 3).groupBy("level", "bucket").agg(F.count("*").alias("n")), "level bucket n", "",
    "SELECT level, xor(xor(CAST(floor(x/s) AS BIGINT), CAST(floor(y/s) AS BIGINT)*2654435761), CAST(floor(z/s) AS BIGINT)*805459861) & 1023 AS bucket, count(*) AS n FROM points3d, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level, unnest([4.0::DOUBLE, 2.0, 1.0]) AS s) l GROUP BY 1, 2")
add("a36_collisions", "points3d", lambda p: points.hash_collisions(points.spatial_hash(p, 4.0, 10, 3)), "level cells buckets shared", "",
    "SELECT level, CAST(sum(n) AS BIGINT) AS cells, count(*) AS buckets, count(*) FILTER (WHERE n > 1) AS shared FROM (SELECT level, bucket, count(*) AS n FROM (SELECT DISTINCT level, ix, iy, iz, xor(xor(ix, iy*2654435761), iz*805459861) & 1023 AS bucket FROM (SELECT level, CAST(floor(x/s) AS BIGINT) AS ix, CAST(floor(y/s) AS BIGINT) AS iy, CAST(floor(z/s) AS BIGINT) AS iz FROM points3d, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level, unnest([4.0::DOUBLE, 2.0, 1.0]) AS s) l)) GROUP BY 1, 2) GROUP BY level")
add("a17_refine_box", "points3d", lambda p: points.refine_box(points.voxel_downsample(p, 5.0).select("scene_id", "ix", "iy", "iz", "x", "y", "z", (F.col("ix") - F.col("iy") + 0.5).alias("value")), 0.1), "scene_id", "min_x min_y min_z max_x max_y max_z",
    "WITH v AS (SELECT scene_id, CAST(floor(x/5) AS BIGINT) AS ix, CAST(floor(y/5) AS BIGINT) AS iy, CAST(floor(z/5) AS BIGINT) AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points3d GROUP BY 1, 2, 3, 4) SELECT scene_id, min(x)-0.1 AS min_x, min(y)-0.1 AS min_y, min(z)-0.1 AS min_z, max(x)+0.1 AS max_x, max(y)+0.1 AS max_y, max(z)+0.1 AS max_z FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE b.scene_id = a.scene_id AND abs(a.ix-b.ix)+abs(a.iy-b.iy)+abs(a.iz-b.iz) = 1 AND sign(a.ix-a.iy+0.5)*sign(b.ix-b.iy+0.5) < 0) GROUP BY scene_id")
only("a14_estimate_normals", "points3d", lambda p: points.estimate_normals(p, 6))
add("a15_mesh_points", "points3d pixels", lambda p, q: points.mesh_points(*_mesh(p, q)), "scene_id triangle_id corner x y z r", "",
    "WITH c AS (SELECT p.scene_id, p.point3d_id AS triangle_id, corner, p.point3d_id + corner AS vertex_id, CAST(p.r AS DOUBLE)/255*(corner+1)/4 AS u, CAST(p.g AS DOUBLE)/255 AS v FROM points3d p, (SELECT CAST(unnest(range(3)) AS INTEGER) AS corner) k), t AS (SELECT scene_id, image_id*10+y AS row, x AS col, max(class_id) AS r FROM pixels GROUP BY 1, 2, 3), z AS (SELECT scene_id, max(row)+1 AS th, max(col)+1 AS tw FROM t GROUP BY 1) SELECT c.scene_id, c.triangle_id, c.corner, p.x, p.y, p.z, t.r FROM c JOIN z ON z.scene_id = c.scene_id JOIN points3d p ON p.scene_id = c.scene_id AND p.point3d_id = c.vertex_id JOIN t ON t.scene_id = c.scene_id AND t.row = greatest(least(CAST(floor((1-v)*th) AS BIGINT), th-1), 0) AND t.col = greatest(least(CAST(floor(u*tw) AS BIGINT), tw-1), 0)")


def _mesh(p: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    corners = F.array(*[F.col("point3d_id") + k for k in range(3)])
    uv = F.array(*[F.array(F.col("r") / 255.0 * ((k + 1) / 4), F.col("g") / 255.0) for k in range(3)])
    triangles = p.select("scene_id", F.col("point3d_id").alias("triangle_id"), corners.alias("corners"), uv.alias("uv"))
    texels = q.groupBy("scene_id", (F.col("image_id") * 10 + F.col("y")).alias("row"), F.col("x").alias("col")).agg(F.max("class_id").alias("r"), F.max("class_id").alias("g"), F.max("class_id").alias("b"))
    return triangles, p.select("scene_id", F.col("point3d_id").alias("vertex_id"), "x", "y", "z"), texels


def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.pca_rgb(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").select("vec_id", "pc0", "pc1", "pc2")


QUERIES["a31_pca_rgb"] = _pca
# Poses and scenes
add("p04_original_space", "frames", lambda f: scenes.to_original_space(scenes.to_scene_space(scenes.with_pose(f), scenes.scene_transforms(f)), scenes.scene_transforms(f)).select("frame_id", *[F.element_at("c2w", k).alias(f"e{k}") for k in (1, 2, 3, 4, 6, 8, 11, 12)]), "frame_id", "e1 e2 e3 e4 e6 e8 e11 e12",
    f"SELECT frame_id, a00 AS e1, -a01 AS e2, -a02 AS e3, tx AS e4, -a11 AS e6, ty AS e8, -a22 AS e11, tz AS e12 FROM {POSE}")
only("a02_scene_focus", "frames", lambda f: scenes.scene_focus(scenes.with_pose(f)))
only("a04_orient_vertical", "frames", lambda f: scenes.orient_vertical(scenes.with_pose(f)))
only("a05_orient_pca", "frames", lambda f: scenes.orient_pca(scenes.with_pose(f)))
add("a08_dynamic_scale", "frames", lambda f: scenes.dynamic_scale(f.groupBy("scene_id").agg((F.max("tx") + 20).alias("scale"), F.min("blur_score").alias("near"), F.max("blur_score").alias("far")), 1.5), "scene_id", "factor scale near far",
    "SELECT scene_id, f AS factor, s*f AS scale, near*s*f AS near, far*s*f AS far FROM (SELECT *, 1.5::DOUBLE/4/(s*far) AS f FROM (SELECT scene_id, max(tx)+20 AS s, min(blur_score) AS near, max(blur_score) AS far FROM frames GROUP BY scene_id))")
add("a32_pose_delta", "frames", lambda f: scenes.pose_delta_stats(scenes.with_pose(f), scenes.with_pose(f.withColumns({"tx": F.col("tx") * 1.01, "yaw": F.col("yaw") + 0.1}))), "scene_id", "max_shift mean_shift max_turn mean_turn penalty",
    "SELECT scene_id, max(abs(tx*0.01)) AS max_shift, avg(abs(tx*0.01)) AS mean_shift, degrees(0.1::DOUBLE) AS max_turn, degrees(0.1::DOUBLE) AS mean_turn, avg(abs(tx*0.01))*0.01+0.1::DOUBLE*0.001 AS penalty FROM frames GROUP BY scene_id")
add("a34_catalogue", "frames cameras", lambda f, c: scenes.catalogue(f.groupBy("scene_id").agg(F.count("*").alias("n")).join(c.groupBy("scene_id").agg(F.max(F.greatest(F.col("width"), F.col("fx").cast("int"))).alias("side")), "scene_id")), "images resolution scenes most", "",
    "SELECT i AS images, r AS resolution, count(*) AS scenes, max(side) AS most FROM (SELECT CASE WHEN n < 250 THEN '<250' WHEN n < 1000 THEN '250-999' WHEN n < 4000 THEN '1000-3999' ELSE '>=4000' END AS i, CASE WHEN side < 640 THEN '<640' WHEN side < 1280 THEN '640-1279' WHEN side < 1920 THEN '1280-1919' WHEN side < 3840 THEN '1920-3839' ELSE '>=3840' END AS r, side FROM (SELECT scene_id, count(*) AS n FROM frames GROUP BY 1) JOIN (SELECT scene_id, max(greatest(width, CAST(fx AS INTEGER))) AS side FROM cameras GROUP BY 1) USING (scene_id)) GROUP BY CUBE (i, r)")
add("f13_valid_poses", "frames", lambda f: scenes.pose_faults(_broken(f)), "scene_id n infinite not_a_number", "", "SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE blur_score > 60) AS infinite, count(*) FILTER (WHERE blur_score < 1 AND NOT blur_score > 60) AS not_a_number FROM frames GROUP BY scene_id")
add("f13_kept_poses", "frames", lambda f: scenes.valid_poses(_broken(f)), "frame_id", "", "SELECT frame_id FROM frames WHERE blur_score BETWEEN 1 AND 60")


def _broken(f: DataFrame) -> DataFrame:
    return scenes.with_pose(f.withColumns({"tx": F.when(F.col("blur_score") > 60, float("-inf")).otherwise(F.col("tx")), "ty": F.when(F.col("blur_score") < 1, float("nan")).otherwise(F.col("ty"))}))


add("p07_auto_downscale", "cameras frames", lambda c, f: scenes.auto_downscale(c.groupBy("scene_id").agg((F.max("width") * 8).alias("width"), (F.max("height") * 8).alias("height")), f.select("scene_id", F.pow(F.lit(2.0), F.col("camera_id") % 3).cast("long").alias("factor")).filter("factor > 1")), "scene_id factor", "",
    "WITH l AS (SELECT DISTINCT scene_id, CAST(pow(2, camera_id % 3) AS BIGINT) AS factor FROM frames), s AS (SELECT scene_id, max(width)*8 AS side FROM cameras GROUP BY 1) SELECT s.scene_id, min(k.f) AS factor FROM s, (SELECT CAST(pow(2, unnest(range(21))) AS BIGINT) AS f) k LEFT JOIN l ON l.scene_id = s.scene_id AND l.factor = 2*k.f AND l.factor > 1 WHERE side/k.f <= 1600 OR l.factor IS NULL GROUP BY s.scene_id")
LISTS = "(SELECT scene_id, CASE WHEN camera_id = 0 THEN 'train' ELSE 'val' END AS split, file_path FROM frames WHERE blur_score > 70)"


def _lists(f: DataFrame) -> DataFrame:
    return f.filter("blur_score > 70").select("scene_id", F.when(F.col("camera_id") == 0, "train").otherwise("val").alias("split"), "file_path")


add("k05_split", "frames", lambda f: scenes.split(f, _lists(f), "interval", every=8), "scene_id frame_id split", "",
    f"SELECT f.scene_id, f.frame_id, CASE WHEN l.split = 'train' THEN 'train' ELSE 'eval' END AS split FROM frames f JOIN {LISTS} l USING (scene_id, file_path) UNION ALL SELECT scene_id, frame_id, CASE WHEN idx % 8 = 0 THEN 'eval' ELSE 'train' END AS split FROM {PLACED} WHERE scene_id NOT IN (SELECT scene_id FROM {LISTS})")
add("k20_subset_with_splits", "frames", lambda f: scenes.subset_with_splits(f, _lists(f), 40)[1], "scene_id split file_path", "",
    f"SELECT l.scene_id, l.split, l.file_path FROM {LISTS} l JOIN (SELECT * FROM {PLACED} p WHERE n <= 40 OR idx IN (SELECT CAST(CASE WHEN j = 39 THEN n - 1 ELSE round_even(j*(CAST(n-1 AS DOUBLE)/39), 0) END AS BIGINT) FROM (SELECT unnest(range(40)) AS j))) k USING (scene_id, file_path)")
only("w13_order_poses", "frames", lambda f: scenes.order_poses(f).select("scene_id", "frame_id", "place"))
only("k16_farthest_first", "frames", lambda f: scenes.farthest_first(f.withColumn("unsampled", F.col("camera_id")), 12))
add("w14_interpolate_path", "frames", lambda f: scenes.interpolate_path(scenes.with_pose(f.withColumn("pitch", F.lit(0.0))), 4, ("blur_score",)), "scene_id frame_id step", "x y z qw qx qy qz blur_score",
    """SELECT scene_id, frame_id, step, tx+(ex-tx)*s AS x, ty+(ey-ty)*s AS y, tz+(ez-tz)*s AS z, abs(cos(a/2)) AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, CASE WHEN abs(cos(a/2)) < 1e-9 THEN abs(sin(a/2)) WHEN cos(a/2) < 0 THEN -sin(a/2) ELSE sin(a/2) END AS qz, blur_score+(eb-blur_score)*s AS blur_score
 FROM (SELECT *, yaw+s*(CASE WHEN dy > pi() THEN dy-2*pi() WHEN dy < -pi() THEN dy+2*pi() ELSE dy END) AS a FROM (SELECT *, ew-yaw AS dy, step/3.0::DOUBLE AS s FROM (SELECT *, lead(tx) OVER w AS ex, lead(ty) OVER w AS ey, lead(tz) OVER w AS ez, lead(yaw) OVER w AS ew, lead(blur_score) OVER w AS eb FROM frames WINDOW w AS (PARTITION BY scene_id ORDER BY frame_id)), (SELECT CAST(unnest(range(4)) AS INTEGER) AS step) k WHERE ex IS NOT NULL))
 WHERE abs(abs(dy)-pi()) > 1e-6""")
_w14 = QUERIES["w14_interpolate_path"]
# Where the yaw turns by half a circle, both ways round are shortest: such steps are left out on both sides.
_half = lambda spark, sf_dir: view(spark, sf_dir, "frames").withColumn("gap", F.abs(F.abs(F.lead("yaw").over(scenes.Window.partitionBy("scene_id").orderBy("frame_id")) - F.col("yaw")) - 3.141592653589793)).filter("gap <= 1e-6").select("frame_id")
QUERIES["w14_interpolate_path"] = lambda spark, sf_dir: _w14(spark, sf_dir).join(_half(spark, sf_dir), "frame_id", "left_anti").select(*_w14(spark, sf_dir).columns)
add("t01_union_splits", "frames", lambda f: scenes.union_splits(scenes.split_filename(f)), "scene_id frame_id split position", "", "SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 3 END, file_path) - 1 AS position FROM (SELECT scene_id, frame_id, file_path, CASE WHEN contains(file_path, 'train') THEN 'train' ELSE 'eval' END AS split FROM frames)")
add("t02_difference", "frames", lambda f: f.select("scene_id", "file_path").exceptAll(scenes.split_fraction(f, 0.9).filter("split = 'train'").select("scene_id", "file_path")), "scene_id file_path", "", f"SELECT scene_id, file_path FROM {SPLIT} WHERE split = 'eval'")
add("t03_intersection", "frames", lambda f: _lists(f).select("scene_id", "file_path").intersect(scenes.split_interval(f, 3).filter("split = 'eval'").select("scene_id", "file_path")), "scene_id file_path", "", f"SELECT l.scene_id, l.file_path FROM {LISTS} l JOIN {PLACED} p USING (scene_id, file_path) WHERE idx % 3 = 0")
add("t04_unmatched_names", "frames named", lambda f, n: f.select("scene_id", F.regexp_replace("file_path", r"^images/(.*)\.png$", "$1.jpg").alias("file_name")).join(n, ["scene_id", "file_name"], "left_anti"), "scene_id file_name", "", "SELECT scene_id, file_name FROM (SELECT scene_id, replace(replace(file_path, 'images/', ''), '.png', '.jpg') AS file_name FROM frames) WHERE (scene_id, file_name) NOT IN (SELECT scene_id, file_name FROM named)")
# Joins
add("j04_sensor_star", "frames cameras", lambda f, c: joins.sensor_star(*_star(f, c)).select("sample_data_id", *[F.element_at("c2w", k).alias(f"e{k}") for k in (1, 4, 8, 12)]), "sample_data_id", "e1 e4 e8 e12",
    f"SELECT frame_id AS sample_data_id, -a00 AS e1, -(a00*(camera_id+1)+a01*2+tx) AS e4, -(a10*(camera_id+1)+a11*2+ty) AS e8, a20*(camera_id+1)+a21*2+tz AS e12 FROM {POSE}")


def _star(f: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p = scenes.with_pose(f)
    eye = [1.0, 0.0, 0.0, None, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0, 0.0]
    sensors = c.select("scene_id", F.col("camera_id").alias("sensor_id"), F.array(*[(F.col("camera_id") + 1).cast("double") if x is None else F.lit(x) for x in eye]).alias("sensor_pose"))
    data = p.select("scene_id", F.col("frame_id").alias("sample_data_id"), F.col("frame_id").alias("sample_id"), F.col("camera_id").alias("sensor_id"), F.col("frame_id").alias("ego_id"))
    return data, p.select("scene_id", F.col("frame_id").alias("sample_id"), "captured_at"), sensors, p.select("scene_id", F.col("frame_id").alias("ego_id"), F.col("c2w").alias("ego_pose"))


add("j05_reconcile", "frames named", lambda f, n: joins.reconcile(f.select("scene_id", F.regexp_replace("file_path", r"^images/(.*)\.png$", r"$1.raw").alias("file_name")), n), "scene_id matched no_image no_metadata", "",
    "SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (WHERE b.k IS NULL) AS no_image, count(*) FILTER (WHERE a.k IS NULL) AS no_metadata FROM (SELECT scene_id, replace(replace(file_path, 'images/', ''), '.png', '') AS k FROM frames) a FULL JOIN (SELECT scene_id, replace(file_name, '.jpg', '') AS k FROM named) b ON a.k = b.k AND a.scene_id = b.scene_id GROUP BY 1")
add("j06_component_poses", "frames cameras", lambda f, c: joins.component_poses(scenes.with_pose(f).withColumn("component_id", F.col("camera_id")), c.filter("camera_id < 3").select("scene_id", F.col("camera_id").alias("component_id"), F.array(*[F.lit(float(x)) for x in (0, -1, 0)], F.col("fx"), *[F.lit(float(x)) for x in (1, 0, 0, 2, 0, 0, 1, 3)]).alias("transform"))).select("frame_id", *[F.element_at("c2w", k).alias(f"e{k}") for k in (1, 4, 8, 12)]), "frame_id", "e1 e4 e8 e12",
    f"SELECT frame_id, CASE WHEN camera_id < 3 THEN -a10 ELSE a00 END AS e1, CASE WHEN camera_id < 3 THEN -ty+fx ELSE tx END AS e4, CASE WHEN camera_id < 3 THEN tx+2 ELSE ty END AS e8, CASE WHEN camera_id < 3 THEN tz+3 ELSE tz END AS e12 FROM {POSE} JOIN cameras USING (scene_id, camera_id)")
add("j10_fallback_lookup", "people visits", lambda p, v: joins.fallback_lookup(p, v, "key", "least"), "key", "least",
    "SELECT p.key, arg_min(v.least, k) AS least FROM people p JOIN (SELECT unnest([0, 1, 2]) AS k, unnest([0, -1, 1]) AS d) s ON true JOIN visits v ON v.key = p.key + d GROUP BY p.key")
add("j12_renamed_images", "frames named", lambda f, n: joins.renamed_images(f.select("scene_id", "frame_id", F.regexp_replace("file_path", r"^images/(.*)\.png$", "$1.jpg").alias("name")), n.select("scene_id", F.col("file_name").alias("old_name"), F.concat(F.lit("frame_"), F.substring("file_name", 7, 8), F.lit(".png")).alias("new_name"))), "scene_id frame_id name", "",
    "SELECT f.scene_id, f.frame_id, coalesce('frame_' || substr(n.file_name, 7, 8) || '.png', f.name) AS name FROM (SELECT scene_id, frame_id, replace(replace(file_path, 'images/', ''), '.png', '.jpg') AS name FROM frames) f LEFT JOIN named n ON n.scene_id = f.scene_id AND n.file_name = f.name")
add("j14_constant_bounds", "rays", lambda r: rays.constant_bounds(r, 0.05, 1000.0), "scene_id ray_id", "near far", "SELECT scene_id, ray_id, 0.05::DOUBLE AS near, 1000.0::DOUBLE AS far FROM rays")
def _boxes(p: DataFrame) -> DataFrame:
    return p.select("scene_id", (F.col("point3d_id") % 40).alias("sample_id"), F.col("point3d_id").alias("box_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), (F.col("g") / 64).alias("sx"), F.lit(2.0).alias("sy"), F.lit(0.5).alias("sz"), (F.col("r") / 40).alias("yaw"))


def _small(f: DataFrame, c: DataFrame) -> DataFrame:
    """Shots of ten by ten pixels, the own car in the last rows of every third camera's."""
    i = images(f, c).withColumns({**{k: F.lit(v) for k, v in LENS.items()}, "width": F.lit(10), "height": F.lit(10), "sample_id": F.col("image_id") % 40})
    return i.withColumn("ego_rows", F.when(F.col("camera_id") % 3 == 0, 2).otherwise(0))


# What of a box is in sight is spanned by the corners in front and by all ways from those to corners behind, cut at the plane.
OUTLINES = f"""(SELECT scene_id, image_id, box_id, width, height, {{u}} AS u, {{v}} AS v FROM (
 SELECT scene_id, image_id, box_id, width, height, fx, fy, cx, cy, x, y, d FROM c WHERE d > 0.01
 UNION ALL SELECT p.scene_id, p.image_id, p.box_id, p.width, p.height, p.fx, p.fy, p.cx, p.cy, p.x+(q.x-p.x)*(p.d-0.01)/(p.d-q.d) AS x, p.y+(q.y-p.y)*(p.d-0.01)/(p.d-q.d) AS y, 0.01::DOUBLE AS d
 FROM c p JOIN c q USING (scene_id, image_id, box_id) WHERE p.d > 0.01 AND q.d <= 0.01))"""
CORNERS = """(SELECT scene_id, image_id, box_id, width, height, fx, fy, cx, cy, a00*dx+a10*dy+a20*dz AS x, a01*dx+a11*dy+a21*dz AS y, -(a02*dx+a12*dy+a22*dz) AS d
 FROM (SELECT i.*, box_id, b0+cos(turn)*sx*i0-sin(turn)*sy*i1-i.tx AS dx, b1+sin(turn)*sx*i0+cos(turn)*sy*i1-i.ty AS dy, b2+sz*i2-i.tz AS dz
 FROM (SELECT scene_id, point3d_id % 40 AS sample_id, point3d_id AS box_id, x AS b0, y AS b1, z AS b2, CAST(g AS DOUBLE)/64 AS sx, 2.0::DOUBLE AS sy, 0.5::DOUBLE AS sz, CAST(r AS DOUBLE)/40 AS turn FROM points3d) b
 JOIN {images} i ON i.scene_id = b.scene_id AND i.image_id % 40 = b.sample_id, (SELECT unnest([-0.5::DOUBLE, 0.5]) AS i0) k0, (SELECT unnest([-0.5::DOUBLE, 0.5]) AS i1) k1, (SELECT unnest([-0.5::DOUBLE, 0.5]) AS i2) k2))"""
U, V = "fx*x/d+cx", "cy-fy*y/d"
SMALL = f"(SELECT * REPLACE (8.0::DOUBLE AS fx, 8.0::DOUBLE AS fy, 5.0::DOUBLE AS cx, 5.0::DOUBLE AS cy, 10 AS width, 10 AS height) FROM {SHOTS})"
SPANS = f"""(WITH c AS {CORNERS.format(images=SMALL)}, q AS {OUTLINES.format(u=f"round_even({U}, 0)", v=f"round_even({V}, 0)")},
 s AS (SELECT a.scene_id, a.image_id, a.box_id, a.width, y, CASE WHEN a.v = b.v THEN least(a.u, b.u) ELSE a.u+(y-a.v)*(b.u-a.u)/(b.v-a.v) END AS lo, CASE WHEN a.v = b.v THEN greatest(a.u, b.u) ELSE a.u+(y-a.v)*(b.u-a.u)/(b.v-a.v) END AS hi
  FROM q a JOIN q b USING (scene_id, image_id, box_id), (SELECT unnest(range(10)) AS y) r WHERE y BETWEEN least(a.v, b.v) AND greatest(a.v, b.v))
 SELECT * FROM (SELECT scene_id, image_id, box_id, y, CAST(greatest(ceil(min(lo)-1e-9), 0) AS BIGINT) AS x0, CAST(least(floor(max(hi)+1e-9), max(width)-1) AS BIGINT) AS x1 FROM s GROUP BY 1, 2, 3, 4) WHERE x0 <= x1
 UNION ALL SELECT scene_id, image_id, NULL, y, 0, 9 FROM shots, (SELECT unnest([8, 9]) AS y) r WHERE camera_id % 3 = 0 AND (scene_id, camera_id) IN (SELECT (scene_id, camera_id) FROM cameras))"""
add("j19_project_boxes", "points3d frames cameras", lambda p, f, c: joins.project_boxes(_boxes(p), images(f, c).withColumn("sample_id", F.col("image_id") % 40), 2.0), "scene_id image_id box_id", "x0 y0 x1 y1",
    f"WITH c AS {CORNERS.format(images=IMAGES)}, q AS {OUTLINES.format(u=U, v=V)}, e AS (SELECT scene_id, image_id, box_id, min(u) AS x0, min(v) AS y0, max(u) AS x1, max(v) AS y1, max(width) AS width, max(height) AS height FROM q GROUP BY 1, 2, 3) SELECT scene_id, image_id, box_id, greatest(least(x0-2, width), 0) AS x0, greatest(least(y0-2, height), 0) AS y0, greatest(least(x1+2, width), 0) AS x1, greatest(least(y1+2, height), 0) AS y1 FROM e WHERE x1 > 0 AND y1 > 0 AND x0 < width AND y0 < height")
add("j19_box_spans", "points3d shots cameras", lambda p, f, c: joins.box_spans(_boxes(p), _small(f, c)), "scene_id image_id box_id y x0 x1", "", f"SELECT * FROM {SPANS}")
add("j19_box_masks", "pixels points3d shots cameras", lambda q, p, f, c: joins.span_masks(q, joins.box_spans(_boxes(p), _small(f, c))), "scene_id image_id y x keep", "",
    f"WITH m AS {SPANS} SELECT p.scene_id, p.image_id, p.y, p.x, NOT EXISTS (SELECT 1 FROM m WHERE m.scene_id = p.scene_id AND m.image_id = p.image_id AND m.y = p.y AND p.x BETWEEN m.x0 AND m.x1) AS keep FROM pixels p")
# Pixels
add("p08_camera_rays", "pixels shots cameras", lambda p, f, c: cameras.camera_rays(p, _typed(images(f, c))), "scene_id image_id y x", "ox oy oz dx dy dz norm area", "")
ORACLES.pop("p08_camera_rays")


def _typed(i: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("perspective", "fisheye", "equirectangular", "orthophoto")]), (F.col("image_id") % 4 + 1).cast("int"))
    return i.withColumn("camera_type", kind)


only("p09_undistort", "pixels shots cameras", lambda p, f, c: cameras.camera_rays(p, _typed(images(f, c)).withColumns({"k1": F.col("camera_id") / 50, "k2": F.lit(-0.01), "k3": F.lit(0.0), "k4": F.lit(0.0), "p1": F.lit(0.001), "p2": F.lit(-0.002)}), distorted=True))
add("p13_normals_to_world", "pixels shots cameras", lambda p, f, c: pixels.normals_to_world(p.select("scene_id", "image_id", "y", "x", F.col("gt").alias("n0"), F.col("pred").alias("n1"), (F.col("gt") * 0.5).alias("n2")), images(f, c)), "scene_id image_id y x", "w0 w1 w2",
    f"SELECT scene_id, image_id, y, x, (a00*p+a01*q+a02*r)/n AS w0, (a10*p+a11*q+a12*r)/n AS w1, (a20*p+a21*q+a22*r)/n AS w2 FROM (SELECT *, sqrt(p*p+q*q+r*r) AS n FROM (SELECT d.scene_id, d.image_id, d.y, d.x, 2*gt-1 AS p, 2*pred-1 AS q, gt-1 AS r, i.* EXCLUDE (scene_id, image_id) FROM pixels d JOIN {SHOTS} i ON i.scene_id = d.scene_id AND i.image_id = d.image_id))")
add("p15_equirect_plan", "cameras", lambda c: cameras.equirect_plan(c.select("scene_id", F.col("camera_id").alias("image_id"), "width", "height"), 8, (0.1, 0.0, 0.0, 0.25)), "scene_id image_id view side", "yaw pitch fov",
    "SELECT scene_id, camera_id AS image_id, view, CAST(floor(sqrt(height*width/8.0::DOUBLE)) AS BIGINT) AS side, yaw, pitch, 120.0::DOUBLE AS fov FROM cameras, (VALUES (0, -90.0::DOUBLE, -16.5::DOUBLE), (1, 0.0, -16.5), (2, 90.0, -16.5), (3, -90.0, 12.0), (4, 90.0, 12.0), (5, -90.0, -53.25), (6, 90.0, -53.25)) v(view, yaw, pitch)")
only("p16_equirect_project", "pixels", lambda p: cameras.equirect_project(p.select("scene_id", "image_id", "y", "x", F.col("gt").alias("value")), cameras.equirect_plan(p.groupBy("scene_id", "image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")), 8)))
add("p17_cropped_pyramid", "pixels", lambda p: pixels.image_pyramid(pixels.crop_pixels(p, 10, 10, 1, (0.1, 0.0, 0.0, 0.2)), 2), "scene_id image_id level py px", "value",
    "SELECT scene_id, image_id, level, CAST(floor((y-2)/pow(2, level)) AS BIGINT) AS py, CAST(floor((x-1)/pow(2, level)) AS BIGINT) AS px, avg(gt) AS value FROM pixels, (SELECT CAST(unnest(range(2)) AS INTEGER) AS level) l WHERE x >= 1 AND x < 7 AND y >= 2 AND y < 9 GROUP BY ALL")
add("p18_make_mask", "pixels", lambda p: pixels.make_mask(p, (1, 0, 10, 8), 0.6, 10, 10), "scene_id image_id y x keep", "", "SELECT scene_id, image_id, y, x, x >= 1 AND x < 10 AND y >= 0 AND y < 8 AND pow(x-4.5::DOUBLE, 2)+pow(y-4.5::DOUBLE, 2) <= 0.36::DOUBLE*50 AS keep FROM pixels")
add("f11_check_masks", "frames cameras", lambda f, c: pixels.check_masks(_masked(f, c)), "scene_id masks_differ depths_differ wrong_size", "",
    "SELECT * FROM (SELECT scene_id, count(*) FILTER (WHERE blur_score < 60) BETWEEN 1 AND count(*)-1 AS masks_differ, count(*) FILTER (WHERE camera_id < 5) BETWEEN 1 AND count(*)-1 AS depths_differ, count(*) FILTER (WHERE blur_score < 60 AND camera_id = 4) AS wrong_size FROM frames GROUP BY scene_id) WHERE masks_differ OR depths_differ OR wrong_size > 0")


def _masked(f: DataFrame, c: DataFrame) -> DataFrame:
    j = f.join(c, ["scene_id", "camera_id"])
    return j.select("scene_id", F.when(F.col("blur_score") < 60, "m").alias("mask_path"), F.when(F.col("camera_id") < 5, "d").alias("depth_path"), "width", "height", F.when(F.col("camera_id") == 4, 1).otherwise(F.col("width")).alias("mask_width"), F.col("height").alias("mask_height"))


add("f12_valid_depth", "pixels", pixels.valid_depth, "scene_id image_id y x", "depth_gt", "SELECT scene_id, image_id, y, x, depth_gt FROM pixels WHERE depth_gt > 0")
add("k17_dilate_mask", "pixels", lambda p: pixels.dilate_mask(p, 1), "scene_id image_id y x mask", "", "SELECT p.scene_id, p.image_id, p.y, p.x, bool_or(q.mask) AS mask FROM pixels p JOIN pixels q ON p.scene_id = q.scene_id AND p.image_id = q.image_id AND abs(p.x-q.x) <= 1 AND abs(p.y-q.y) <= 1 GROUP BY ALL")
add("a23_ssim", "pixels", pixels.ssim, "scene_id image_id", "ssim",
    "SELECT scene_id, image_id, avg((2*a*b+1e-4)*(2*(ab-a*b)+9e-4)/((a*a+b*b+1e-4)*(aa-a*a+bb-b*b+9e-4))) AS ssim FROM (SELECT p.scene_id, p.image_id, p.y, p.x, sum(q.gt)/121 AS a, sum(q.pred)/121 AS b, sum(q.gt*q.gt)/121 AS aa, sum(q.pred*q.pred)/121 AS bb, sum(q.gt*q.pred)/121 AS ab FROM pixels p JOIN pixels q ON p.scene_id = q.scene_id AND p.image_id = q.image_id AND abs(p.x-q.x) <= 5 AND abs(p.y-q.y) <= 5 GROUP BY ALL) GROUP BY scene_id, image_id")
ALIGNED = "(SELECT p.scene_id, p.image_id, y, x, CASE WHEN depth_gt > 0 THEN scale*depth_pred+shift-depth_gt END AS e FROM pixels p JOIN (SELECT scene_id, image_id, CASE WHEN abs(a*n-b*b) > 1e-9 THEN (n*c-b*d)/(a*n-b*b) ELSE 0 END AS scale, CASE WHEN abs(a*n-b*b) > 1e-9 THEN (a*d-b*c)/(a*n-b*b) ELSE 0 END AS shift FROM (SELECT scene_id, image_id, sum(depth_pred*depth_pred) AS a, sum(depth_pred) AS b, CAST(count(*) AS DOUBLE) AS n, sum(depth_pred*depth_gt) AS c, sum(depth_gt) AS d FROM pixels WHERE depth_gt > 0 GROUP BY 1, 2)) s USING (scene_id, image_id))"
STEPS = f"(SELECT scene_id, image_id, k, coalesce(sum(gx), 0)+coalesce(sum(gy), 0) AS g, count(e) AS n FROM (SELECT *, abs(e-lag(e) OVER (PARTITION BY scene_id, image_id, k, y ORDER BY x)) AS gx, abs(e-lag(e) OVER (PARTITION BY scene_id, image_id, k, x ORDER BY y)) AS gy FROM {ALIGNED}, (SELECT unnest([1, 2, 4, 8]) AS k) s WHERE x % k = 0 AND y % k = 0) GROUP BY 1, 2, 3)"
add("a27_gradient_error", "pixels", pixels.gradient_error, "scene_id image_id n", "image_loss g", f"SELECT scene_id, image_id, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN n > 0 THEN g/n ELSE 0 END) AS image_loss, sum(g) AS g FROM {STEPS} GROUP BY 1, 2")
add("a27_batch_error", "pixels", lambda p: pixels.batch_reduced(pixels.gradient_error(p)), "scene_id", "batch_loss image_loss", f"SELECT scene_id, sum(g)/sum(n) AS batch_loss, avg(image_loss) AS image_loss FROM (SELECT scene_id, image_id, sum(n) AS n, sum(CASE WHEN n > 0 THEN g/n ELSE 0 END) AS image_loss, sum(g) AS g FROM {STEPS} GROUP BY 1, 2) GROUP BY 1")
add("a28_normal_error", "pixels", lambda p: pixels.normal_error(p.selectExpr("scene_id", "image_id", "gt AS ax", "pred AS ay", "1D AS az", "pred AS bx", "gt AS by", "0.5D AS bz")), "scene_id image_id", "l1 cosine", "SELECT scene_id, image_id, avg(2*abs(gt-pred)+0.5) AS l1, avg(1-(2*gt*pred+0.5)) AS cosine FROM pixels GROUP BY 1, 2")
only("a30_color_correct", "pixels", lambda p: pixels.color_correct(p.selectExpr("scene_id", "image_id", "y", "x", "gt AS r", "pred AS g", "gt * pred AS b", "0.9 * gt AS ref_r", "pred * pred AS ref_g", "0.5 * gt + 0.2 AS ref_b")))
# Rays
add("w08_interlevel", "ray_samples", lambda s: rays.interlevel(rays.ray_weights(s), rays.ray_weights(s).withColumns({"t_start": F.col("t_start") + 0.2, "weight": F.col("weight") * 0.5})), "scene_id ray_id", "loss",
    f"SELECT w.scene_id, w.ray_id, sum(pow(greatest(w.weight-coalesce(bound, 0), 0), 2)/(w.weight+1e-7)) AS loss FROM {WEIGHTS} w LEFT JOIN (SELECT t.scene_id, t.ray_id, t.sample_idx, sum(e.weight*0.5) AS bound FROM ray_samples t JOIN {WEIGHTS} e ON t.scene_id = e.scene_id AND t.ray_id = e.ray_id AND e.t_start+0.2 < t.t_start+t.delta AND e.t_start+0.2+e.delta > t.t_start GROUP BY 1, 2, 3) x USING (scene_id, ray_id, sample_idx) GROUP BY 1, 2")
add("w09_line_of_sight", "ray_samples", lambda s: rays.depth_supervision(s, s.groupBy("scene_id", "ray_id").agg(F.max("t_start").alias("depth")), 0.6, "sight"), "scene_id ray_id", "loss",
    f"SELECT w.scene_id, w.ray_id, pow(any_value(depth)-sum(weight*mid)/(sum(weight)+1e-10), 2)+sum(CASE WHEN abs(mid-depth) <= 0.6 THEN pow(weight-exp(-pow(mid-depth, 2)/(2*0.2::DOUBLE*0.2::DOUBLE))/(0.2::DOUBLE*sqrt(2*pi())), 2) WHEN mid-depth < -0.6 THEN weight*weight ELSE 0 END) AS loss FROM {WEIGHTS} w JOIN (SELECT scene_id, ray_id, max(t_start) AS depth FROM ray_samples GROUP BY 1, 2) d ON d.scene_id = w.scene_id AND d.ray_id = w.ray_id GROUP BY 1, 2")
add("w10_normal_penalties", "ray_samples rays", lambda s, r: rays.normal_penalties(s.withColumns({"nx": F.col("r"), "ny": F.col("g") - 0.5, "nz": F.col("b"), "px": F.col("b"), "py": F.col("r"), "pz": F.col("g")}), r), "scene_id ray_id", "orientation predicted",
    f"SELECT scene_id, ray_id, sum(weight*pow(least(-(r*dx+(g-0.5)*dy+b*dz), 0), 2)) AS orientation, sum(weight*(1-(r*b+(g-0.5)*r+b*g))) AS predicted FROM {WEIGHTS} w JOIN (SELECT scene_id, ray_id, dx, dy, dz FROM rays) q USING (scene_id, ray_id) GROUP BY 1, 2")
add("w11_sample_rays_piecewise", "rays", lambda r: rays.sample_rays(r, 8, 0.5, 6.0, "piecewise"), "scene_id ray_id sample_idx", "t_start t_end",
    "SELECT scene_id, ray_id, k AS sample_idx, CASE WHEN a < 0.5 THEN 2*a ELSE 1/(2-2*a) END AS t_start, CASE WHEN b < 0.5 THEN 2*b ELSE 1/(2-2*b) END AS t_end FROM (SELECT *, 0.25+(1-1/12.0::DOUBLE-0.25)*k/8 AS a, 0.25+(1-1/12.0::DOUBLE-0.25)*(k+1)/8 AS b FROM rays, (SELECT CAST(unnest(range(8)) AS INTEGER) AS k) s)")
only("w11_jittered", "rays", lambda r: rays.sample_rays(r, 8, 2.0, 6.0, "uniform", seed=7))
# Telemetry
add("w15_eta", "telemetry", lambda t: telemetry.moving_avg(t, 20, 500), "run_id name step", "avg eta", "SELECT *, greatest(500-step, 0)*avg AS eta FROM (SELECT run_id, name, step, avg(value) OVER (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg FROM telemetry)")
add("w16_latest_stats", "telemetry", lambda t: telemetry.latest_stats(t, 5, 50), "run_id name step", "value done",
    "SELECT a.run_id, a.name, a.step, arg_max(t.value, t.step) AS value, least(a.step/50.0::DOUBLE, 1) AS done FROM (SELECT DISTINCT s.run_id, n.name, s.at AS step FROM (SELECT DISTINCT run_id, step // 5 * 5 AS at FROM telemetry) s JOIN (SELECT DISTINCT run_id, name FROM telemetry) n ON n.run_id = s.run_id) a JOIN telemetry t ON t.run_id = a.run_id AND t.name = a.name AND t.step <= a.step GROUP BY 1, 2, 3")
add("a25_render_rates", "frames cameras", lambda f, c: telemetry.render_rates(f.join(c, ["scene_id", "camera_id"]).select(F.col("scene_id").alias("run_id"), "width", "height", (F.col("blur_score") / 100 + 0.1).alias("seconds"))), "run_id", "rays_per_second rays_std fps fps_std",
    "SELECT scene_id AS run_id, avg(r) AS rays_per_second, stddev_samp(r) AS rays_std, avg(1/s) AS fps, stddev_samp(1/s) AS fps_std FROM (SELECT scene_id, width*height/(blur_score/100+0.1::DOUBLE) AS r, blur_score/100+0.1::DOUBLE AS s FROM frames JOIN cameras USING (scene_id, camera_id)) GROUP BY 1")
add("k15_dynamic_budget", "telemetry", lambda t: telemetry.dynamic_budget(t, 250.0, 4096), "run_id size", "",
    "WITH RECURSIVE o AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS k FROM telemetry), f AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS k, CAST(4096 AS BIGINT) AS size FROM o UNION ALL SELECT o.run_id, o.k, CAST(least(greatest(floor(f.size*250.0::DOUBLE/greatest(value, 1)), 1), 2147483648) AS BIGINT) FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k+1) SELECT run_id, arg_max(size, k) AS size FROM f GROUP BY run_id")
# Hooks
def _lengths(batch):
    """A hook as a user writes one: lengths of the directions of a batch of rays."""
    import pyarrow as pa
    import pyarrow.compute as pc

    squares = [pc.multiply(batch.column(c), batch.column(c)) for c in ("dx", "dy", "dz")]
    return pa.RecordBatch.from_arrays([batch.column("scene_id"), batch.column("ray_id"), pc.sqrt(pc.add(pc.add(squares[0], squares[1]), squares[2]))], names=["scene_id", "ray_id", "length"])


def _ray_schema(r: DataFrame) -> str:
    kinds = dict(r.dtypes)
    return f"scene_id {kinds['scene_id']}, ray_id {kinds['ray_id']}, length double"


def _hook_in_sql(r: DataFrame) -> DataFrame:
    hooks.register_hook(r.sparkSession, "ray_lengths", _lengths, _ray_schema(r))
    return r.sparkSession.sql("SELECT * FROM ray_lengths(TABLE({rays}))", rays=r)


LENGTHS = "SELECT scene_id, ray_id, sqrt(dx*dx+dy*dy+dz*dz) AS length FROM rays"
add("u01_ray_hook", "rays", lambda r: hooks.hooked(r, (_lengths, _ray_schema(r))), "scene_id ray_id", "length", LENGTHS)
add("u01_ray_hook_sql", "rays", _hook_in_sql, "scene_id ray_id", "length", LENGTHS)
# Samples
SIZES = "(SELECT scene_id, image_id, CAST(max(x)+1 AS BIGINT) AS width, CAST(max(y)+1 AS BIGINT) AS height FROM pixels GROUP BY 1, 2)"


def _sizes(p: DataFrame) -> DataFrame:
    return p.groupBy("scene_id", "image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


for _name, _draw in {
    "k07_sample_pixels": lambda p: sampling.sample_pixels(p.sparkSession, _sizes(p), 4096, 1),
    "k07_sample_masked": lambda p: sampling.sample_masked(p, 512, 1),
    "k09_sample_equirect": lambda p: sampling.sample_equirect(p.sparkSession, _sizes(p), 4096, 2),
    "k10_sample_disc": lambda p: sampling.sample_disc(p.sparkSession, _sizes(p), 4096, 5.0, 3),
    "k11_sample_patches": lambda p: sampling.sample_patches(p.sparkSession, _sizes(p), 4096, 4, 4),
    "k11_masked_patches": lambda p: sampling.sample_masked_patches(p, 4096, 2, 4),
    "k12_sample_pairs": lambda p: sampling.sample_pairs(p.sparkSession, _sizes(p), 4096, 2, 5),
    "k14_sample_by_level": lambda p: sampling.sample_by_level(p.selectExpr("scene_id", "image_id", "y AS row", "x AS col", "class_id AS level"), _sizes(p), 4096, 8, 1, 6),
}.items():
    only(_name, "pixels", _draw)
only("k21_sample_rows", "rays", lambda r: sampling.sample_rows(r, 1000, 9))
add("k21_slice_rows", "rays", lambda r: sampling.slice_rows(r, 10, 40), "scene_id ray_id", "ox dx", "SELECT scene_id, ray_id, ox, dx FROM rays QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY ray_id) - 1 BETWEEN 10 AND 39")


# Streams
def _stream(name: str, build: Callable[[DataFrame], DataFrame], mode: str, result: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A streaming query over the events at hand, put into the input folder in time order as some files; its batches are a Parquet table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        events.repartitionByRange(4, "ts", "event_id").write.parquet(f"{folder}/in")
        live.drain(build(live.ingest(spark, f"{folder}/in", events.schema)), mode, f"{folder}/log", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out"))
        shared.delete(spark, f"{folder}/in")
        return result(spark.read.parquet(f"{folder}/out"))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


RUNS = "user_id AS run_id", "event_type AS name", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "value"
_stream("x01_ingest", lambda e: live.exploded(e.withColumn("values", F.map_from_arrays(F.array(F.col("event_type"), F.lit("count")), F.array("value", F.lit(1.0))))), "append", lambda d: d.groupBy("run_id", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")),
        "SELECT run_id, name, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id AS run_id, event_type AS name, value FROM events UNION ALL SELECT user_id, 'count', 1.0::DOUBLE FROM events) GROUP BY 1, 2")
_stream("x02_windowed_stats", lambda e: live.windowed_stats(e.selectExpr(*RUNS), "1 hour", "30 days"), "update", lambda d: d.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "name").agg(F.max("n").alias("n"), F.round(F.max_by("mean", "n"), 6).alias("mean")),
        "SELECT date_trunc('hour', ts) AS start, user_id AS run_id, event_type AS name, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3")
_stream("x02_sliding_stats", lambda e: live.windowed_stats(e.selectExpr(*RUNS), "2 hours", "30 days", "1 hour"), "update", lambda d: d.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "name").agg(F.max("n").alias("n")),
        "SELECT start, run_id, name, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(unnest([0, 1])) AS start, user_id AS run_id, event_type AS name FROM events) GROUP BY 1, 2, 3")
_stream("x03_moving_average", lambda e: live.moving_average(e.selectExpr(*RUNS), 20), "append", lambda d: d.select("run_id", "name", "event_id", F.round("avg", 6).alias("avg")),
        "SELECT user_id AS run_id, event_type AS name, event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg FROM events")
_stream("x05_run_sessions", lambda e: live.run_sessions(e.selectExpr(*RUNS), "6 hours", "30 days"), "complete", lambda d: d.join(d.agg(F.max("batch").alias("batch")), "batch").select("run_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("end").cast("timestamp_ntz").alias("end"), F.round("seconds", 3).alias("seconds")),
        """SELECT user_id AS run_id, min(ts) AS start, count(*) AS n, max(ts) AS "end", round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM (SELECT *, sum(CASE WHEN ts - p >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s""")
_stream("x06_deduplicated", lambda e: live.deduplicated(e.selectExpr(*RUNS).unionByName(e.selectExpr(*RUNS)), "1 day"), "append", lambda d: d.groupBy("run_id").agg(F.count("*").alias("n")), "SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY 1")
