"""Queries on cameras, rotations, matches and solving."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import attitude, catalogue, exposures, images, joins, solver
from ..operators.scratch import stored
from ..sources.frames import encode_png
from .fixtures import frame, with_tables
from .registry import query

r6 = lambda c: F.round(c, 6)
W, H, FOV = 320.0, 240.0, 0.35
_VECTOR = "SELECT frame_id, det_idx, 1 / n AS vx, a / n AS vy, b / n AS vz FROM (SELECT *, sqrt(1 + a * a + b * b) AS n FROM (SELECT frame_id, det_idx, (160 - x) * 2 * tan(0.175e0) / 320 AS a, (120 - y) * 2 * tan(0.175e0) / 320 AS b FROM detections) t) t"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = g.pixel_vector("x", "y", W, H, FOV)
    return frame(spark, sf_dir, "detections").select("frame_id", "det_idx", *[c.alias(f"v{k}") for c, k in zip(v, "xyz", strict=True)])


@query(with_tables("detections") + f"SELECT frame_id, det_idx::BIGINT AS det_idx, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz FROM ({_VECTOR}) v")
def centroid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), *[r6(f"v{k}").alias(f"v{k}") for k in "xyz"])


@query(
    with_tables("stars", "frames") + """, r AS (SELECT frame_id, cos(ra0) * cos(dec0) AS bx, sin(ra0) * cos(dec0) AS by_, sin(dec0) AS bz, -sin(ra0) AS ex, cos(ra0) AS ey FROM frames)
    , p AS (SELECT frame_id, star_idx, r.bx * s.x + r.by_ * s.y + r.bz * s.z AS a, r.ex * s.x + r.ey * s.y AS b, (-bz * ey) * s.x + (bz * ex) * s.y + (bx * ey - by_ * ex) * s.z AS c FROM r JOIN stars s ON r.bx * s.x + r.by_ * s.y + r.bz * s.z > cos(0.2))
    , q AS (SELECT frame_id, star_idx, round(160 - 160 / tan(0.175e0) * b / a, 6) AS px, round(120 - 160 / tan(0.175e0) * c / a, 6) AS py FROM p)
    SELECT * FROM q WHERE px > 0 AND px < 320 AND py > 0 AND py < 240"""
)
def project_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot = g.rotation("ra0", "dec0", F.lit(0.0))
    centres = frame(spark, sf_dir, "frames").select("frame_id", *[c.alias(n) for c, n in zip(rot, attitude.R, strict=True)])
    near = joins.cones(centres.withColumns({"x": F.col("r00"), "y": F.col("r01"), "z": F.col("r02")}), frame(spark, sf_dir, "stars").select("star_idx", "x", "y", "z"), 0.2)
    px, py = g.vector_pixel(g.rotate([F.col(c) for c in attitude.R], g.vec("r")), W, H, FOV)
    return near.select("frame_id", "star_idx", r6(px).alias("px"), r6(py).alias("py")).where(g.in_frame(F.col("px"), F.col("py"), W, H))


_UNDISTORT = "SELECT *, sqrt(pow(x - 160, 2) + pow(y - 120, 2)) / 160 AS r FROM detections"


@query(with_tables("detections") + f"SELECT frame_id, det_idx::BIGINT AS det_idx, round((x - 160) * ((1 + 0.1e0 * r * r) / 1.1e0) + 160, 4) AS ux, round((y - 120) * ((1 + 0.1e0 * r * r) / 1.1e0) + 120, 4) AS uy FROM ({_UNDISTORT}) t")
def undistort(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.undistort("x", "y", W, H, -0.1)
    return frame(spark, sf_dir, "detections").select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), F.round(x, 4).alias("ux"), F.round(y, 4).alias("uy"))


_STEP = "(r - (r * (1 + 0.1e0 * r * r) / 1.1e0 - goal) / ((1 + 0.3e0 * r * r) / 1.1e0)) AS r"
_NEWTON = "SELECT frame_id, det_idx, x, y, sqrt(pow(x - 160, 2) + pow(y - 120, 2)) / 160 AS goal, sqrt(pow(x - 160, 2) + pow(y - 120, 2)) / 160 AS r FROM detections"
for _ in range(12):
    _NEWTON = f"SELECT frame_id, det_idx, x, y, goal, {_STEP} FROM ({_NEWTON}) n"


@query(with_tables("detections") + f"SELECT frame_id, det_idx::BIGINT AS det_idx, round((x - 160) * CASE WHEN goal > 0 THEN r / goal ELSE 1 END + 160, 6) AS dx, round((y - 120) * CASE WHEN goal > 0 THEN r / goal ELSE 1 END + 120, 6) AS dy FROM ({_NEWTON}) n")
def distort_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.distort("x", "y", W, H, -0.1)
    return frame(spark, sf_dir, "detections").select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), r6(x).alias("dx"), r6(y).alias("dy"))


@query(with_tables("detections") + "SELECT frame_id, det_idx::BIGINT AS det_idx, round(atan((160 - x) / (160 / tan(0.5e0))), 6) AS ra, round(atan((120 - y) / (120 / tan(0.375e0))), 6) AS dec FROM detections")
def camera_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = g.camera_angles("x", "y", 1.0, W, H)
    return frame(spark, sf_dir, "detections").select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), r6(ra).alias("ra"), r6(dec).alias("dec"))


@query(with_tables("detections") + "SELECT frame_id, det_idx::BIGINT AS det_idx, round((x - 320) / 500 / n, 6) AS ux, round((y - 240) / 500 / n, 6) AS uy, round(1 / n, 6) AS uz FROM (SELECT *, sqrt(pow((x - 320) / 500, 2) + pow((y - 240) / 500, 2) + 1) AS n FROM detections) t")
def u_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = g.u_body("x", "y")
    return frame(spark, sf_dir, "detections").select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), *[r6(c).alias(f"u{k}") for c, k in zip(u, "xyz", strict=True)])


_PREDICTED = "SELECT frame_id, det_idx AS cat_idx, (x * 7 + y * 3) % 320 AS cx, (x * 2 + y * 5) % 240 AS cy FROM detections"


@query(
    with_tables("detections") + f""", c AS ({_PREDICTED}), met AS (SELECT d.frame_id, d.det_idx AS img, c.cat_idx AS cat FROM detections d JOIN c ON c.frame_id = d.frame_id AND sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < 40)
    , one AS (SELECT frame_id, img, min(cat) AS cat FROM met GROUP BY frame_id, img) SELECT frame_id, cat::BIGINT AS cat, min(img)::BIGINT AS img FROM one GROUP BY frame_id, cat"""
)
def centroid_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "detections").withColumn("det_idx", F.col("det_idx").cast("long"))
    left = d.select("frame_id", F.col("det_idx").alias("img"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = d.select("frame_id", F.col("det_idx").alias("cat"), ((F.col("x") * 7 + F.col("y") * 3) % 320).alias("rx"), ((F.col("x") * 2 + F.col("y") * 5) % 240).alias("ry"))
    return joins.first_matches(joins.frame_join(left, right, 40.0, 40.0, ["frame_id"]), ["frame_id"], "img", "cat").select("frame_id", "cat", "img")


@query(
    with_tables("detections") + """, f AS (SELECT frame_id, count(*)::DOUBLE AS n, count(*) FILTER (intensity > 20)::DOUBLE AS m, 0.002e0 * (1 + frame_id % 40) AS p FROM detections GROUP BY frame_id)
    , t AS (SELECT frame_id, n, m, p, unnest(range(0, CAST(n AS BIGINT) + 1)) AS i FROM f)
    SELECT frame_id, round(max(CASE WHEN m <= 2 THEN 1.0 ELSE 0.0 END) + sum(CASE WHEN m > 2 AND i >= m - 2 THEN gamma(n + 1) / gamma(i + 1) / gamma(n - i + 1) * pow(p, i) * pow(1 - p, n - i) ELSE 0 END), 9) AS prob FROM t GROUP BY frame_id"""
)
def mismatch_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "detections").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("intensity") > 20).alias("m"))
    return f.select("frame_id", F.round(g.mismatch_probability(F.col("m"), F.col("n"), F.lit(0.002) * (1 + F.col("frame_id") % 40)), 9).alias("prob"))


_ROT = """, e AS (SELECT frame_id, cos(ra0) * cos(dec0) AS r00, sin(ra0) * cos(dec0) AS r01, sin(dec0) AS r02, -sin(ra0) AS ex, cos(ra0) AS ey, 0e0 AS ez, roll0 FROM frames)
    , n AS (SELECT *, r01 * ez - r02 * ey AS nx, r02 * ex - r00 * ez AS ny, r00 * ey - r01 * ex AS nz FROM e)
    , rot AS (SELECT frame_id, r00, r01, r02, sin(roll0) * nx + cos(roll0) * ex AS r10, sin(roll0) * ny + cos(roll0) * ey AS r11, sin(roll0) * nz + cos(roll0) * ez AS r12,
        cos(roll0) * nx - sin(roll0) * ex AS r20, cos(roll0) * ny - sin(roll0) * ey AS r21, cos(roll0) * nz - sin(roll0) * ez AS r22 FROM n)
"""


def _rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "frames").select("frame_id", *[c.alias(n) for c, n in zip(g.rotation("ra0", "dec0", "roll0"), attitude.R, strict=True)])


@query(
    with_tables("frames") + _ROT + """SELECT frame_id, round((degrees(atan2(r01, r00)) + 360) % 360, 5) AS ra, round(degrees(atan2(r02, sqrt(r12 * r12 + r22 * r22))), 5) AS dec, round((degrees(atan2(r12, r22)) + 360) % 360, 5) AS roll FROM rot"""
)
def rotation_to_radec(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = g.attitude_angles([F.col(c) for c in attitude.R])
    return _rotations(spark, sf_dir).select("frame_id", *[F.round(a, 5).alias(n) for a, n in zip(angles, ("ra", "dec", "roll"), strict=True)])


@query(
    with_tables("frames") + _ROT + """, v AS (SELECT *, 1 / sqrt(1 + a * a + b * b) AS i FROM (SELECT *, (160 - frame_id % 320) * 2 * tan(0.175e0) / 320 AS a, (120 - frame_id % 240) * 2 * tan(0.175e0) / 320 AS b FROM rot) t)
    , s AS (SELECT frame_id, (r00 + a * r10 + b * r20) * i AS x, (r01 + a * r11 + b * r21) * i AS y, (r02 + a * r12 + b * r22) * i AS z FROM v)
    SELECT frame_id, round((degrees(atan2(y, x)) + 360) % 360, 5) AS ra_target, round(90 - degrees(acos(greatest(-1, least(1, z)))), 5) AS dec_target FROM s"""
)
def target_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rotations(spark, sf_dir).withColumn("fov", F.degrees(F.lit(FOV)))
    found = solver.target_sky(rows, F.col("frame_id") % 320, F.col("frame_id") % 240, W, H)
    return found.select("frame_id", F.round("ra_target", 5).alias("ra_target"), F.round("dec_target", 5).alias("dec_target"))


@query(
    with_tables("frames") + _ROT + """, q AS (SELECT *, r00 + r11 + r22 AS t, r00 > r11 AND r00 > r22 AS b1, r11 > r22 AS b2 FROM rot)
    , u AS (SELECT frame_id, CASE WHEN t > 0 THEN [sqrt(1 + t) / 2, (r21 - r12) / (2 * sqrt(1 + t)), (r02 - r20) / (2 * sqrt(1 + t)), (r10 - r01) / (2 * sqrt(1 + t))]
        WHEN b1 THEN [(r21 - r12) / (2 * sqrt(1 + r00 - r11 - r22)), sqrt(1 + r00 - r11 - r22) / 2, (r01 + r10) / (2 * sqrt(1 + r00 - r11 - r22)), (r02 + r20) / (2 * sqrt(1 + r00 - r11 - r22))]
        WHEN b2 THEN [(r02 - r20) / (2 * sqrt(1 + r11 - r00 - r22)), (r01 + r10) / (2 * sqrt(1 + r11 - r00 - r22)), sqrt(1 + r11 - r00 - r22) / 2, (r12 + r21) / (2 * sqrt(1 + r11 - r00 - r22))]
        ELSE [(r10 - r01) / (2 * sqrt(1 + r22 - r00 - r11)), (r02 + r20) / (2 * sqrt(1 + r22 - r00 - r11)), (r12 + r21) / (2 * sqrt(1 + r22 - r00 - r11)), sqrt(1 + r22 - r00 - r11) / 2] END AS q FROM q)
    SELECT frame_id, round(q[1] * s, 5) + 0 AS qw, round(q[2] * s, 5) + 0 AS qx, round(q[3] * s, 5) + 0 AS qy, round(q[4] * s, 5) + 0 AS qz FROM (SELECT *, CASE WHEN q[1] < 0 THEN -1e0 ELSE 1e0 END AS s FROM u) t"""
)
def rotmat_to_quat(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = g.quaternion([F.col(c) for c in attitude.R])
    return _rotations(spark, sf_dir).select("frame_id", *[(F.round(c, 5) + 0.0).alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])


_TURNED = "SELECT *, az AS mx, ax AS my, ay AS mz, bz AS nx, bx AS ny, by_ AS nz FROM directions WHERE abs(ax * bx + ay * by_ + az * bz) < 0.95"


@query(
    with_tables("directions") + f""", d AS ({_TURNED}), c AS (SELECT *, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz, my * nz - mz * ny AS ex, mz * nx - mx * nz AS ey, mx * ny - my * nx AS ez FROM d)
    , u AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS nc, sqrt(ex * ex + ey * ey + ez * ez) AS ne FROM c)
    , t AS (SELECT vec_id, [ax, ay, az] AS b1, [cx / nc, cy / nc, cz / nc] AS b2, [mx, my, mz] AS s1, [ex / ne, ey / ne, ez / ne] AS s2 FROM u)
    , w AS (SELECT *, [b1[2] * b2[3] - b1[3] * b2[2], b1[3] * b2[1] - b1[1] * b2[3], b1[1] * b2[2] - b1[2] * b2[1]] AS b3, [s1[2] * s2[3] - s1[3] * s2[2], s1[3] * s2[1] - s1[1] * s2[3], s1[1] * s2[2] - s1[2] * s2[1]] AS s3 FROM t)
    SELECT vec_id, round(s1[1] * b1[1] + s2[1] * b2[1] + s3[1] * b3[1], 5) + 0 AS r00, round(s1[1] * b1[3] + s2[1] * b2[3] + s3[1] * b3[3], 5) + 0 AS r02, round(s1[2] * b1[1] + s2[2] * b2[1] + s3[2] * b3[1], 5) + 0 AS r10, round(s1[3] * b1[2] + s2[3] * b2[2] + s3[3] * b3[2], 5) + 0 AS r21 FROM w"""
)
def triad(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _turned(spark, sf_dir)
    r = g.triad(g.vec("a"), g.vec("b"), g.vec("m"), g.vec("n"))
    return d.select("vec_id", *[(F.round(r[k], 5) + 0.0).alias(attitude.R[k]) for k in (0, 2, 3, 7)])


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two directions a row in the body frame (a, b) and, with axes exchanged, in the inertial frame (m, n)."""
    d = frame(spark, sf_dir, "directions").withColumnRenamed("by_", "by")
    d = d.where(F.abs(g.dot(g.vec("a"), g.vec("b"))) < 0.95)
    return d.withColumns({"mx": F.col("az"), "my": F.col("ax"), "mz": F.col("ay"), "nx": F.col("bz"), "ny": F.col("bx"), "nz": F.col("by")})


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched directions in groups of about eight: body b, inertial n."""
    d = _turned(spark, sf_dir)
    group = F.floor(F.col("vec_id") / 8).alias("frame_id")
    return d.select(group, *[F.col(f"a{k}").alias(f"b{k}") for k in "xyz"], *[F.col(f"m{k}").alias(f"n{k}") for k in "xyz"])


_PAIRS = f", d AS ({_TURNED}), pairs AS (SELECT CAST(floor(vec_id / 8e0) AS BIGINT) AS frame_id, ax AS bx, ay AS by_, az AS bz, mx AS nx, my AS ny, mz AS nz FROM d)"


@query(with_tables("directions") + _PAIRS + "SELECT frame_id, count(*)::BIGINT AS n_pairs, " + ", ".join(f"round(sum({a} * {b}), 6) + 0 AS p{i}{j}" for i, a in enumerate(("bx", "by_", "bz")) for j, b in enumerate(("nx", "ny", "nz"))) + " FROM pairs GROUP BY frame_id")
def attitude_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = attitude.profile(_pairs(spark, sf_dir), ["frame_id"])
    return p.select("frame_id", "n_pairs", *[(r6(f"p{i}{j}") + 0.0).alias(f"p{i}{j}") for i in range(3) for j in range(3)])


# For the two methods every group has a turn of its own, from angles that step with its number.
_SPUN = (
    f""", d AS ({_TURNED}), groups AS (SELECT CAST(floor(vec_id / 8e0) AS BIGINT) AS frame_id, ax, ay, az FROM d)
    , frames AS (SELECT frame_id, count(*)::BIGINT AS n_pairs, radians((frame_id * 73.13e0) % 360e0) AS ra0, radians((frame_id * 31.7e0) % 160e0 - 80e0) AS dec0, radians((frame_id * 41.37e0) % 360e0) AS roll0 FROM groups GROUP BY frame_id HAVING count(*) >= 2)"""
    + _ROT
)


def _spun(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "directions").withColumnRenamed("by_", "by").where(F.abs(g.dot(g.vec("a"), g.vec("b"))) < 0.95)
    d = d.select(F.floor(F.col("vec_id") / 8).alias("frame_id"), "ax", "ay", "az")
    turn = g.rotation(F.radians((F.col("frame_id") * 73.13) % 360.0), F.radians((F.col("frame_id") * 31.7) % 160.0 - 80), F.radians((F.col("frame_id") * 41.37) % 360.0))
    return d.select("frame_id", *[F.col(f"a{k}").alias(f"b{k}") for k in "xyz"], *[c.alias(f"n{k}") for c, k in zip(g.rotate_back(turn, g.vec("a")), "xyz", strict=True)])


_QUAT = """, q AS (SELECT *, r00 + r11 + r22 AS t, r00 > r11 AND r00 > r22 AS b1, r11 > r22 AS b2 FROM rot)
    , u AS (SELECT frame_id, CASE WHEN t > 0 THEN [sqrt(1 + t) / 2, (r21 - r12) / (2 * sqrt(1 + t)), (r02 - r20) / (2 * sqrt(1 + t)), (r10 - r01) / (2 * sqrt(1 + t))]
        WHEN b1 THEN [(r21 - r12) / (2 * sqrt(1 + r00 - r11 - r22)), sqrt(1 + r00 - r11 - r22) / 2, (r01 + r10) / (2 * sqrt(1 + r00 - r11 - r22)), (r02 + r20) / (2 * sqrt(1 + r00 - r11 - r22))]
        WHEN b2 THEN [(r02 - r20) / (2 * sqrt(1 + r11 - r00 - r22)), (r01 + r10) / (2 * sqrt(1 + r11 - r00 - r22)), sqrt(1 + r11 - r00 - r22) / 2, (r12 + r21) / (2 * sqrt(1 + r11 - r00 - r22))]
        ELSE [(r10 - r01) / (2 * sqrt(1 + r22 - r00 - r11)), (r02 + r20) / (2 * sqrt(1 + r22 - r00 - r11)), (r12 + r21) / (2 * sqrt(1 + r22 - r00 - r11)), sqrt(1 + r22 - r00 - r11) / 2] END AS q FROM q)
    , s AS (SELECT *, CASE WHEN q[1] < 0 THEN -1e0 ELSE 1e0 END AS sign FROM u)
"""


@query(with_tables("directions") + _SPUN + _QUAT + "SELECT s.frame_id, n_pairs, round(q[1] * sign, 5) + 0 AS qw, round(-q[2] * sign, 5) + 0 AS qx, round(-q[3] * sign, 5) + 0 AS qy, round(-q[4] * sign, 5) + 0 AS qz FROM s JOIN frames f ON f.frame_id = s.frame_id")
def quest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attitude.quest(_spun(spark, sf_dir), ["frame_id"]).select("frame_id", "n_pairs", *[(F.round(c, 5) + 0.0).alias(c) for c in ("qw", "qx", "qy", "qz")])


@query(with_tables("directions") + _SPUN + "SELECT r.frame_id, n_pairs, " + ", ".join(f"round({c}, 5) + 0 AS {c}" for c in ("r00", "r01", "r02", "r12", "r20")) + " FROM rot r JOIN frames f ON f.frame_id = r.frame_id")
def wahba_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attitude.wahba(_spun(spark, sf_dir), ["frame_id"]).where("n_pairs >= 2")
    return found.select("frame_id", "n_pairs", *[(F.round(c, 5) + 0.0).alias(c) for c in ("r00", "r01", "r02", "r12", "r20")])


@query(
    with_tables("directions") + _PAIRS + """, s AS (SELECT frame_id, sqrt(pow(bx - nx, 2) + pow(by_ - ny, 2) + pow(bz - nz, 2)) AS c FROM pairs)
    SELECT frame_id, round(degrees(sqrt(avg(pow(2 * asin(least(c / 2, 1)), 2)))) * 3600, 3) AS rmse FROM s GROUP BY frame_id"""
)
def rmse_arcsec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attitude.rmse_arcsec(_pairs(spark, sf_dir), ["frame_id"]).withColumn("rmse", F.round("rmse", 3))


@query(
    with_tables("detections") + """, m AS (SELECT frame_id, sqrt(pow(x - 160, 2) + pow(y - 120, 2)) / 160 AS r FROM detections), s AS (SELECT frame_id, (r + 0.05e0 * pow(r, 3)) / 3 AS t, r, pow(r, 3) AS c FROM m)
    , n AS (SELECT frame_id, sum(t * t) AS tt, sum(t * c) AS tc, sum(c * c) AS cc, sum(t * r) AS tr, sum(c * r) AS cr FROM s GROUP BY frame_id HAVING count(*) >= 3), d AS (SELECT *, tt * cc - tc * tc AS det FROM n)
    SELECT frame_id, round(f / (1 - k), 4) AS focal, round(k, 4) AS k FROM (SELECT frame_id, (tr * cc - cr * tc) / det AS f, (cr * tt - tr * tc) / det AS k FROM d WHERE det > 1e-6) q"""
)
def focal_distortion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "detections")
    r = F.hypot(F.col("x") - 160, F.col("y") - 120) / 160
    rows = d.select("frame_id", r.alias("r")).withColumn("t", (F.col("r") + 0.05 * F.pow("r", F.lit(3))) / 3)
    sizes = rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.pow("r", F.lit(3))).alias("tc"), F.sum(F.pow("r", F.lit(6))).alias("cc"))
    good = sizes.where((F.col("n") >= 3) & (F.col("tt") * F.col("cc") - F.col("tc") * F.col("tc") > 1e-6)).select("frame_id")
    fit = attitude.focal_fit(rows.join(good, "frame_id", "left_semi"), ["frame_id"], F.col("t"), F.col("r"))
    return fit.select("frame_id", F.round("focal", 4).alias("focal"), F.round("k", 4).alias("k"))


@query(
    with_tables("directions") + f""", d AS ({_TURNED}), p AS (SELECT CAST(floor(vec_id / 8e0) AS BIGINT) AS frame_id, vec_id, ax, ay, az, bx, by_, bz FROM d)
    SELECT a.frame_id, round(avg(2 * asin(least(sqrt(pow(a.bx - b.bx, 2) + pow(a.by_ - b.by_, 2) + pow(a.bz - b.bz, 2)) / 2, 1)) / (2 * asin(least(sqrt(pow(a.ax - b.ax, 2) + pow(a.ay - b.ay, 2) + pow(a.az - b.az, 2)) / 2, 1)))), 5) AS scale
    FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.vec_id < b.vec_id GROUP BY a.frame_id"""
)
def fine_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _turned(spark, sf_dir)
    rows = d.select(F.floor(F.col("vec_id") / 8).alias("frame_id"), "vec_id", *[F.col(f"a{k}").alias(f"b{k}") for k in "xyz"], *[F.col(f"b{k}").alias(f"n{k}") for k in "xyz"])
    return attitude.fine_fov(rows, ["frame_id"], "vec_id").withColumn("scale", F.round("scale", 5))


# A planted sky: each frame sees the stars of its cone through a known rotation.
SKY_FOV, SKY_W, SKY_H = math.radians(25.0), 1024.0, 768.0


#: Stars that frames meet first where only the brightest of each are wanted; about one in 90 is in a frame.
BRIGHTEST_STARS = 4000


def _in_frames(rot: DataFrame, stars: DataFrame, few: bool = False) -> DataFrame:
    centres = rot.withColumns({"x": F.col("r00"), "y": F.col("r01"), "z": F.col("r02")})
    near = joins.cones(centres, stars, SKY_FOV * 0.65, few)
    px, py = g.vector_pixel(g.rotate([F.col(c) for c in attitude.R], g.vec("r")), SKY_W, SKY_H, SKY_FOV)
    return near.select("frame_id", "star_idx", "mag", F.round(px, 2).alias("x"), F.round(py, 2).alias("y")).where(g.in_frame(F.col("x"), F.col("y"), SKY_W, SKY_H))


def planted(spark: SparkSession, sf_dir: str, rot: DataFrame | None = None, most: int | None = None, first: int = BRIGHTEST_STARS) -> DataFrame:
    """``detections`` of the frames' cones: every star in the frame, at a hundredth of a pixel, brightest first.

    With ``most`` only that many of each frame's brightest: frames meet the ``first``
    brightest stars of the sky, and those still short of ``most`` meet the next,
    four times as many each time. The work grows with the frames, not with frames times stars.
    """
    rot = _rotations(spark, sf_dir) if rot is None else rot
    stars = frame(spark, sf_dir, "stars").select("star_idx", "mag", "x", "y", "z")
    order = Window.partitionBy("frame_id").orderBy("star_idx")
    if most is None:
        return _in_frames(rot, stars).withColumn("det_idx", (F.row_number().over(order) - 1).cast("long"))
    open_, stars = stored(rot, "open"), stored(stars, "sky")
    n = stars.count()
    sizes = [first * 4**k for k in range(32) if first * 4**k < n]
    ends = [None, *(stars.approxQuantile("star_idx", [k / n for k in sizes], min(1e-3, 0.1 * first / n)) if sizes else []), None]
    seen = None
    for low, high in zip(ends, ends[1:], strict=False):
        some = stars.where((F.lit(True) if low is None else F.col("star_idx") > low) & (F.lit(True) if high is None else F.col("star_idx") <= high))
        new = stored(_in_frames(open_, some), "seen")
        seen = new if seen is None else seen.unionByName(new)
        if high is None:
            break
        full = seen.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        open_ = stored(open_.join(full, "frame_id", "left_anti"), "open")
        if not open_.limit(1).count():
            break
    return seen.withColumn("det_idx", (F.row_number().over(order) - 1).cast("long")).where(F.col("det_idx") < most)


#: Images have a pixel for each square of this many pixels of the planted frames.
COARSE = 2
#: Shots that a task draws.
SHOTS_A_TASK = 250


#: Half a side of what a star lights, in pixels, and stars that are drawn at once.
LIT, DRAWN = 6, 500


def _draw(image: np.ndarray, y: np.ndarray, x: np.ndarray, light: np.ndarray) -> None:
    """Add a spot for each star at (y, x), some at a time, in their order."""
    height, width = image.shape
    step = np.arange(-LIT, LIT + 1)
    for k in range(0, len(y), DRAWN):
        cy, cx, top = y[k : k + DRAWN, None], x[k : k + DRAWN, None], light[k : k + DRAWN, None]
        ys, xs = cy.astype("i8") + step, cx.astype("i8") + step
        rows, columns = top * np.exp(-((ys + 0.5 - cy) ** 2) / 2.4) * ((ys >= 0) & (ys < height)), np.exp(-((xs + 0.5 - cx) ** 2) / 2.4) * ((xs >= 0) & (xs < width))
        at = np.clip(ys, 0, height - 1)[:, :, None] * width + np.clip(xs, 0, width - 1)[:, None, :]
        np.add.at(image.reshape(-1), at.reshape(-1), (rows[:, :, None] * columns[:, None, :]).reshape(-1))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, content)``: a PNG of 16 bits for each of the ``shots``, with a spot for each star over an uneven ground.

    Stars are dealt by shot as plain rows: they are many, and only the task that draws a shot needs its own.
    """
    shots = frame(spark, sf_dir, "shots")
    rot = shots.select("frame_id", *[c.alias(n) for c, n in zip(g.rotation("ra0", "dec0", "roll0"), attitude.R, strict=True)])
    seen = _in_frames(rot, frame(spark, sf_dir, "stars").select("star_idx", "mag", "x", "y", "z"), few=True).select("frame_id", "y", "x", "mag")
    none = shots.select("frame_id", *[F.lit(None).cast("double").alias(c) for c in ("y", "x", "mag")])  # a shot without stars is a file too
    height, width = int(SKY_H) // COARSE, int(SKY_W) // COARSE
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shots.count() // SHOTS_A_TASK))

    def draw(batches):
        y, x = np.indices((height, width), "i4")
        ground = 300.0 + y / 8 + x / 16 + (x * 7 + y * 13 + x * y % 11) % 5
        for table in images.whole_frames(batches, images.TOGETHER):
            ids, *stars = (table[c].to_numpy() for c in ("frame_id", "y", "x", "mag"))
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for low, high in zip(first, [*first[1:], len(ids)], strict=True):
                own = [c[low:high] for c in stars]
                order = np.lexsort(own[::-1])
                cy, cx, mag = (c[order][~np.isnan(own[0][order])] for c in own)
                image = ground.copy()
                _draw(image, cy / COARSE, cx / COARSE, 12_000 * 10 ** (-0.2 * mag))
                png = encode_png(np.minimum(image, 65_535).astype("u2"))
                yield pa.RecordBatch.from_pydict({"file": [f"{ids[low]:09d}.png"], "content": [png]})

    return seen.unionByName(none).repartition(parts, "frame_id").sortWithinPartitions("frame_id").mapInArrow(draw, "file string, content binary")


def sky_database(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return catalogue.generate(frame(spark, sf_dir, "stars"), SKY_FOV)


_SEPARATION, _REACH = g.separation(SKY_FOV, 10), 2 * math.sin(SKY_FOV / 2)
_CHORD = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query(
    with_tables("stars") + f"""
    , s AS (SELECT star_idx, x, y, z, row_number() OVER (ORDER BY star_idx) AS k FROM stars)
    , close AS (SELECT a.k AS i, b.k AS j FROM s a JOIN s b ON a.k < b.k AND {_CHORD} <= {_SEPARATION!r}::DOUBLE)
    , walk(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
        SELECT w.k + 1, CASE WHEN list_has_any(w.kept, coalesce((SELECT list(i) FROM close WHERE j = w.k + 1), CAST([] AS BIGINT[]))) THEN w.kept ELSE list_append(w.kept, w.k + 1) END FROM walk w WHERE w.k < (SELECT max(k) FROM s))
    , bright AS (SELECT star_idx, x, y, z FROM s WHERE k IN (SELECT unnest(kept) FROM walk WHERE k = (SELECT max(k) FROM s)))
    , near AS (SELECT a.star_idx AS i, b.star_idx AS j, {_CHORD} AS chord FROM bright a JOIN bright b ON a.star_idx < b.star_idx AND {_CHORD} <= {_REACH!r}::DOUBLE)
    , quads AS (SELECT ab.i AS a, ab.j AS b, bc.j AS c, cd.j AS d, list_sort([2 * asin(least(e / 2, 1)) FOR e IN [ab.chord, ac.chord, ad.chord, bc.chord, bd.chord, cd.chord]]) AS edges
        FROM near ab JOIN near bc ON bc.i = ab.j JOIN near ac ON ac.i = ab.i AND ac.j = bc.j JOIN near cd ON cd.i = bc.j JOIN near ad ON ad.i = ab.i AND ad.j = cd.j JOIN near bd ON bd.i = ab.j AND bd.j = cd.j)
    SELECT a, b, c, d, CAST({" + ".join(f"floor(edges[{k + 1}] / edges[6] * {catalogue.BINS}) * {catalogue.BINS**k}" for k in range(5))} AS BIGINT) AS code_key, round(edges[6], 6) AS largest_edge FROM quads"""
)
def database_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, patterns = sky_database(spark, sf_dir)
    order = F.sort_array("stars")
    return patterns.select(*[F.get(order, k).alias(c) for k, c in enumerate("abcd")], "code_key", r6("largest_edge").alias("largest_edge"))


def solved_frames(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    stars, patterns = sky_database(spark, sf_dir)
    detections = planted(spark, sf_dir, most=options.get("verification_stars", solver.VERIFICATION_STARS)).select("frame_id", "det_idx", "x", "y")
    return solver.solve(detections, stars, patterns, SKY_W, SKY_H, frames=frame(spark, sf_dir, "frames"), **options)


def plate_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = solved_frames(spark, sf_dir, fov=SKY_FOV, fov_error=math.radians(1.0))
    return found.select("frame_id", *[F.round(c, 4).alias(c) for c in ("ra", "dec", "roll", "fov")], F.round("rmse", 1).alias("rmse"), "matches")


query()(plate_solve)


def solve_from_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots as files, decoded, extracted and solved in one call."""
    files = stored(rendered(spark, sf_dir), "shots")
    stars, patterns = sky_database(spark, sf_dir)
    found = exposures.solve_images(files, stars, patterns, exposures.Extraction(size=15, min_area=4), fov=SKY_FOV, fov_error=math.radians(1.0))
    return found.select("file", "status", "n_spots", *[F.round(c, 2).alias(c) for c in ("ra", "dec", "roll", "fov")], "matches")


query()(solve_from_images)
