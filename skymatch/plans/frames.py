"""Queries on pixel tables and detections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images
from .fixtures import frame, with_tables
from .registry import query

r6 = lambda c: F.round(c, 6)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "pixels")


_ON = """, st AS (SELECT frame_id, avg(v) AS mean, stddev_pop(v) AS std FROM pixels GROUP BY frame_id), lim AS (SELECT frame_id, least(mean + 3 * std, 255) AS threshold, mean, std FROM st)
    , m AS (SELECT p.* FROM pixels p JOIN lim USING (frame_id) WHERE v > threshold)"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return images.mask(p, images.frame_stats(p, 3.0, 255.0))


@query(with_tables("pixels") + _ON + "SELECT frame_id, y, x, v FROM m")
def threshold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir)


@query(with_tables("pixels") + _ON + "SELECT frame_id, round(mean, 6) AS mean, round(std, 6) AS std, round(threshold, 6) AS threshold FROM lim")
def frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = images.frame_stats(_pixels(spark, sf_dir), 3.0, 255.0)
    return s.select("frame_id", *[r6(c).alias(c) for c in ("mean", "std", "threshold")])


@query(
    with_tables("pixels") + """, g AS (SELECT frame_id, avg(v) AS mean, median(v) AS med FROM pixels GROUP BY frame_id)
    SELECT frame_id, round(sqrt(avg((v - mean) * (v - mean))) * 2, 6) AS root_square, round(median(abs(v - med)) * 1.48e0 * 2, 6) AS median_abs FROM pixels JOIN g USING (frame_id) GROUP BY frame_id"""
)
def noise_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    one = images.noise(images.background(p, "global_mean"), "global_root_square", 2.0).groupBy("frame_id").agg(r6(F.first("threshold")).alias("root_square"))
    two = images.noise(images.background(p, "global_median"), "global_median_abs", 2.0).groupBy("frame_id").agg(r6(F.first("threshold")).alias("median_abs"))
    return one.join(two, "frame_id")




@query(
    with_tables("pixels") + """, o AS (SELECT unnest(range(-3, 4)) AS d)
    , mx AS (SELECT frame_id, y, x, o.d, CASE WHEN x + o.d < 0 THEN -1 - (x + o.d) WHEN x + o.d > 31 THEN 63 - (x + o.d) ELSE x + o.d END AS q FROM pixels, o)
    , ax AS (SELECT m.frame_id, m.y, m.x, avg(p.v) AS v FROM mx m JOIN pixels p ON p.frame_id = m.frame_id AND p.y = m.y AND p.x = m.q GROUP BY m.frame_id, m.y, m.x)
    , my AS (SELECT frame_id, y, x, CASE WHEN y + o.d < 0 THEN -1 - (y + o.d) WHEN y + o.d > 31 THEN 63 - (y + o.d) ELSE y + o.d END AS q FROM pixels, o)
    SELECT m.frame_id, m.y, m.x, round(avg(p.v), 5) AS local FROM my m JOIN ax p ON p.frame_id = m.frame_id AND p.x = m.x AND p.y = m.q GROUP BY m.frame_id, m.y, m.x"""
)
def box_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.box_mean(_pixels(spark, sf_dir), 7).select("frame_id", "y", "x", F.round("local", 5).alias("local"))


@query(with_tables("pixels") + "SELECT frame_id, CAST(floor(y / 4e0) AS INTEGER) AS y, CAST(floor(x / 4e0) AS INTEGER) AS x, sum(v)::BIGINT AS v FROM pixels GROUP BY ALL")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.downsample(_pixels(spark, sf_dir), 4)


@query(with_tables("pixels") + "SELECT frame_id, y - 9 AS y, x - 3 AS x, v FROM pixels WHERE y >= 9 AND y < 25 AND x >= 3 AND x < 23")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.crop(_pixels(spark, sf_dir), 15, 20, dy=1, dx=-3)


_OPEN = """, d(dy, dx) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
    , er AS (SELECT frame_id, y + dy AS y, x + dx AS x FROM m, d GROUP BY ALL HAVING count(*) = 5), op AS (SELECT DISTINCT frame_id, y + dy AS y, x + dx AS x FROM er, d)"""


@query(with_tables("pixels") + _ON + _OPEN + "SELECT frame_id, y, x FROM op")
def opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.opening(_mask(spark, sf_dir).select("frame_id", "y", "x"))


_BLOBS = """, reach(frame_id, p, q) AS (SELECT frame_id, y * 32 + x, y * 32 + x FROM m UNION SELECT r.frame_id, r.p, b.y * 32 + b.x FROM reach r JOIN m b ON b.frame_id = r.frame_id AND abs(b.y - r.q // 32) + abs(b.x - r.q % 32) = 1)
    , root AS (SELECT frame_id, p, min(q) AS root FROM reach GROUP BY frame_id, p)
    , blobs AS (SELECT m.frame_id, m.y, m.x, m.v, dense_rank() OVER (PARTITION BY m.frame_id ORDER BY root) - 1 AS label FROM m JOIN root r ON r.frame_id = m.frame_id AND r.p = m.y * 32 + m.x)"""


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.components(_mask(spark, sf_dir))


@query(with_tables("pixels") + _ON + _BLOBS + "SELECT frame_id, y, x, label FROM blobs")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir).select("frame_id", "y", "x", "label")


_MOMENTS = """, spot AS (SELECT frame_id, label, sum(v)::DOUBLE AS sum, count(*)::BIGINT AS area, sum(x * v)::DOUBLE / sum(v)::DOUBLE AS cx, sum(y * v)::DOUBLE / sum(v)::DOUBLE AS cy, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM blobs GROUP BY frame_id, label)
    , m2 AS (SELECT b.frame_id, b.label, sum((x - cx) * (x - cx) * v) / any_value(sum) AS xx, sum((y - cy) * (y - cy) * v) / any_value(sum) AS yy, sum((x - cx) * (y - cy) * v) / any_value(sum) AS xy FROM blobs b JOIN spot USING (frame_id, label) GROUP BY b.frame_id, b.label)"""


@query(with_tables("pixels") + _ON + _BLOBS + _MOMENTS + "SELECT frame_id, label, sum, round(cy + 0.5, 5) AS y, round(cx + 0.5, 5) AS x, round(xx, 5) AS m2_xx, round(yy, 5) AS m2_yy, round(xy, 5) + 0 AS m2_xy, area FROM spot JOIN m2 USING (frame_id, label)")
def spot_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = images.moments(_blobs(spark, sf_dir))
    return s.select("frame_id", "label", "sum", F.round("y", 5).alias("y"), F.round("x", 5).alias("x"), F.round("m2_xx", 5).alias("m2_xx"), F.round("m2_yy", 5).alias("m2_yy"), (F.round("m2_xy", 5) + 0.0).alias("m2_xy"), "area")


@query(with_tables("pixels") + _ON + _BLOBS + _MOMENTS + "SELECT frame_id, label, CASE WHEN area < 4 THEN 'min_area' WHEN area > 12 THEN 'max_area' WHEN sum < 500 THEN 'min_sum' END AS reject FROM spot")
def spot_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.gate(images.moments(_blobs(spark, sf_dir)), 4, 12, min_sum=500).select("frame_id", "label", "reject")


@query(
    with_tables("pixels") + _ON + _BLOBS + _MOMENTS + """, i AS (SELECT a.frame_id, label, x, y, v, x = x1 OR x = x2 - 1 OR y = y1 OR y = y2 - 1 AS edge, x2 - x1 <= 2 OR y2 - y1 <= 2 AS tiny FROM pixels p JOIN spot a ON a.frame_id = p.frame_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2)
    , ring AS (SELECT frame_id, label, CASE WHEN bool_or(tiny) THEN 0 ELSE avg(v) FILTER (edge) END AS ring, max(v) AS peak FROM i GROUP BY frame_id, label)
    , s AS (SELECT frame_id, label, any_value(ring) AS ring, any_value(peak) - any_value(ring) AS contrast, sum(greatest(v - ring, 0)) AS mass, sum(greatest(v - ring, 0) * x) AS sx, sum(greatest(v - ring, 0) * y) AS sy FROM i JOIN ring USING (frame_id, label) GROUP BY frame_id, label)
    SELECT frame_id, label, round(ring, 5) AS ring, round(contrast, 5) AS contrast, round(mass, 4) AS mass, round(CASE WHEN mass > 0 THEN sx / mass END, 5) AS x, round(CASE WHEN mass > 0 THEN sy / mass END, 5) AS y FROM s"""
)
def ring_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = images.ring_centroids(_pixels(spark, sf_dir), images.boxes(_blobs(spark, sf_dir)))
    return s.select("frame_id", "label", F.round("ring", 5).alias("ring"), F.round("contrast", 5).alias("contrast"), F.round("mass", 4).alias("mass"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    with_tables("pixels") + _ON + _BLOBS + _MOMENTS + """, i AS (SELECT a.frame_id, label, x, y, v FROM pixels p JOIN spot a ON a.frame_id = p.frame_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2), mean AS (SELECT frame_id, label, avg(v) AS mean FROM i GROUP BY frame_id, label)
    , s AS (SELECT frame_id, label, sum(greatest(v - mean, 0)) AS m, sum(greatest(v - mean, 0) * x) AS sx, sum(greatest(v - mean, 0) * y) AS sy, max(v) AS peak FROM i JOIN mean USING (frame_id, label) GROUP BY frame_id, label)
    SELECT frame_id, label, round(sx / m, 5) AS x, round(sy / m, 5) AS y, round(m, 4) AS intensity, peak FROM s WHERE m > 0"""
)
def detector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = images.roi_centroids(_pixels(spark, sf_dir), images.boxes(_blobs(spark, sf_dir)))
    return s.select("frame_id", "label", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("intensity", 4).alias("intensity"), "peak")


@query(with_tables("detections") + "SELECT frame_id, det_idx::BIGINT AS det_idx, intensity FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, y, x) AS r FROM detections) t WHERE r <= 3")
def topk_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "detections").withColumnRenamed("det_idx", "own")
    return images.brightest(d, 3, "intensity").select("frame_id", F.col("own").cast("long").alias("det_idx"), "intensity")


@query(with_tables("detections") + "SELECT frame_id, count(*)::BIGINT AS spots, count(*) FILTER (channel = 'A')::BIGINT AS a, count(*) FILTER (channel = 'N')::BIGINT AS n, count(*) FILTER (channel = 'R')::BIGINT AS r FROM detections GROUP BY frame_id")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count_if(F.col("channel") == c).alias(c.lower())
    return frame(spark, sf_dir, "detections").groupBy("frame_id").agg(F.count(F.lit(1)).alias("spots"), count("A"), count("N"), count("R"))


@query(
    with_tables("detections") + """, g AS (SELECT * FROM detections WHERE channel = 'N'), c AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_idx) AS k FROM detections d WHERE channel <> 'N' AND NOT EXISTS (SELECT 1 FROM g WHERE g.frame_id = d.frame_id AND sqrt(pow(g.x - d.x, 2) + pow(g.y - d.y, 2)) < 60))
    , walk(frame_id, k, kept) AS (SELECT DISTINCT frame_id, 0::BIGINT, CAST([] AS BIGINT[]) FROM c UNION ALL
        SELECT w.frame_id, w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM c o WHERE o.frame_id = w.frame_id AND list_contains(w.kept, o.k) AND sqrt(pow(o.x - n.x, 2) + pow(o.y - n.y, 2)) < 60) THEN w.kept ELSE list_append(w.kept, n.k) END FROM walk w JOIN c n ON n.frame_id = w.frame_id AND n.k = w.k + 1)
    , done AS (SELECT frame_id, arg_max(kept, k) AS kept FROM walk GROUP BY frame_id)
    SELECT c.frame_id, c.det_idx::BIGINT AS det_idx FROM c JOIN done USING (frame_id) WHERE list_contains(kept, c.k)"""
)
def dedup_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "detections")
    colour = d.where("channel <> 'N'").withColumn("order", F.col("det_idx").cast("long"))
    return images.dedup_channels(d.where("channel = 'N'"), colour, 60.0, 60.0).select("frame_id", F.col("order").alias("det_idx"))


@query(with_tables("pixels") + "SELECT p.frame_id, y, x, round((v - lo) * 255e0 / (hi - lo), 5) AS v FROM pixels p JOIN (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY frame_id) s USING (frame_id)")
def normalise_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.normalise(_pixels(spark, sf_dir)).withColumn("v", F.round("v", 5))


@query(
    with_tables("pixels") + """, o AS (SELECT unnest(range(-1, 2)) AS dy), o2 AS (SELECT unnest(range(-1, 2)) AS dx)
    , m AS (SELECT frame_id, y, x, CASE WHEN y + dy < 0 THEN 0 WHEN y + dy > 31 THEN 31 ELSE y + dy END AS qy, CASE WHEN x + dx < 0 THEN 0 WHEN x + dx > 31 THEN 31 ELSE x + dx END AS qx FROM pixels, o, o2)
    SELECT m.frame_id, m.y, m.x, median(p.v)::DOUBLE AS local FROM m JOIN pixels p ON p.frame_id = m.frame_id AND p.y = qy AND p.x = qx GROUP BY m.frame_id, m.y, m.x"""
)
def median_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.median_filter(_pixels(spark, sf_dir), 3).select("frame_id", "y", "x", "local")


_S = 2 * 1.1**2
_WEIGHTS = [math.exp(-k * k / _S) for k in range(-2, 3)]
_KERNEL = ", ".join(f"({k}, {w / sum(_WEIGHTS)!r}::DOUBLE)" for k, w in zip(range(-2, 3), _WEIGHTS, strict=True))
_MIRROR = "CASE WHEN {0} + k < 0 THEN -({0} + k) WHEN {0} + k > 31 THEN 62 - ({0} + k) ELSE {0} + k END"


@query(
    with_tables("pixels") + f""", kernel(k, weight) AS (VALUES {_KERNEL})
    , mx AS (SELECT frame_id, y, x, weight, {_MIRROR.format('x')} AS q FROM pixels, kernel), ax AS (SELECT m.frame_id, m.y, m.x, sum(p.v * weight) AS v FROM mx m JOIN pixels p ON p.frame_id = m.frame_id AND p.y = m.y AND p.x = m.q GROUP BY m.frame_id, m.y, m.x)
    , my AS (SELECT frame_id, y, x, weight, {_MIRROR.format('y')} AS q FROM pixels, kernel)
    SELECT m.frame_id, m.y, m.x, round(sum(p.v * weight), 6) AS v FROM my m JOIN ax p ON p.frame_id = m.frame_id AND p.x = m.x AND p.y = m.q GROUP BY m.frame_id, m.y, m.x"""
)
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.gaussian_blur(_pixels(spark, sf_dir)).withColumn("v", r6("v"))


@query()
def star_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images.detect(_pixels(spark, sf_dir))
    return d.select("frame_id", "det_idx", *[F.round(c, 4).alias(c) for c in ("x", "y", "intensity", "radius", "ux", "uy", "uz")], "peak")


@query()
def spot_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images.extract(_pixels(spark, sf_dir), size=15, min_area=3)
    return d.select("frame_id", "det_idx", *[F.round(c, 4).alias(c) for c in ("x", "y", "sum", "axis_ratio")], "area")


@query()
def window_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    spots = images.extract(p, size=15, min_area=3)
    return images.recentre(p, spots, 9).select("frame_id", "det_idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def iterated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    spots = images.extract(p, size=15, min_area=3)
    return images.iterate_centroids(p, spots).select("frame_id", "det_idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(with_tables("pixels") + "SELECT frame_id, y - 8 AS y, x - 8 AS x, v FROM pixels WHERE y BETWEEN 8 AND 23 AND x BETWEEN 8 AND 23")
def crop_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.crop(_pixels(spark, sf_dir), divisor=2)


@query(with_tables("pixels") + "SELECT frame_id, CAST(floor((y - 4) / 4e0) AS INTEGER) AS y, CAST(floor((x - 8) / 4e0) AS INTEGER) AS x, avg(v) AS v FROM pixels WHERE y BETWEEN 4 AND 27 AND x BETWEEN 8 AND 23 GROUP BY ALL")
def crop_and_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.crop_and_downsample(_pixels(spark, sf_dir), 4, mean=True, height=22, width=16)


@query()
def simple_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.simple_process(_pixels(spark, sf_dir))


def _colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels as three channels, of which the red one has a spot of its own and the blue one is dimmer."""
    spot = F.when((F.abs(F.col("y") - 27) + F.abs(F.col("x") - 8) <= 2) & (F.col("channel") == "R"), 150 - 25 * (F.abs(F.col("y") - 27) + F.abs(F.col("x") - 8))).otherwise(0)
    rows = _pixels(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, "BGR"))).alias("channel"))
    value = F.least(F.lit(255), F.floor(F.col("v") * F.when(F.col("channel") == "B", 0.8).otherwise(1.0)) + spot)
    return rows.withColumn("v", value.cast("int"))


@query()
def two_stage_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.two_stage(_colour(spark, sf_dir)).select("frame_id", "channel", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
