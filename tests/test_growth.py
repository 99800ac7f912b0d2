"""What a task and a shuffle hold as tables grow."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from skymatch.operators import attitude, images, joins, kvector, scratch
from skymatch.plans import camera, fixtures


def test_points_of_a_frame_are_copied_four_times(spark):
    rng = random.Random(5)
    points = [(k % 3, k, rng.uniform(-50, 320), rng.uniform(-50, 240)) for k in range(300)] + [(0, 1000 + k, 80.0 * k, 40.0 * k) for k in range(4)]
    left = spark.createDataFrame(points, "frame_id long, img long, lx double, ly double")
    right = spark.createDataFrame(points, "frame_id long, cat long, rx double, ry double")
    met = joins.frame_join(left, right, 40.0, 40.0, ["frame_id"]).select("img", "cat").collect()
    assert sorted(map(tuple, met)) == sorted((a[1], b[1]) for a in points for b in points if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) < 40)
    assert joins.reached(right, 40.0).count() <= 4 * 300 + 9 * 4  # on a seam there are three cells an axis


def test_tasks_that_make_pixels_grow_with_the_frames(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "FRAMES_A_TASK", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        assert fixtures.frame(spark, "/root/testdata/sf0.001", "pixels").rdd.getNumPartitions() == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_detections_that_ask_alike_are_counted_once(spark, monkeypatch):
    rows = {}

    def stored(df, name):
        out = scratch.stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(kvector, "stored", stored)
    rng = random.Random(3)
    sky_ = [(k, rng.uniform(0, 0.6), rng.uniform(-0.3, 0.3)) for k in range(120)]
    stars = spark.createDataFrame([(k, ra, dec, math.cos(ra) * math.cos(dec), math.sin(ra) * math.cos(dec), math.sin(dec)) for k, ra, dec in sky_], "star_idx long, ra double, dec double, x double, y double, z double")
    shapes = [[(rng.uniform(0, 320), rng.uniform(0, 240)) for _ in range(5)] for _ in range(3)]
    detections = spark.createDataFrame([(f, d, *at) for f in range(60) for d, at in enumerate(shapes[f % 3])], "frame_id long, det_idx long, x double, y double")
    pairs = kvector.build(stars, 0.01, 0.2, 100).cache()
    vote = lambda dets: kvector.vote(dets, pairs, 1.0, 320, 240, 0.01, 0.2, 100, 0.002)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in vote(detections).collect()}
    assert len(got) == 300 and 0 < rows["ones"] <= 15 and rows["asked"] >= 20 * rows["ones"]
    assert any(v for _, v in got.values())
    for f in range(3):  # a frame by itself, that shares with none
        alone = {tuple(r)[:2]: tuple(r)[2:] for r in vote(detections.where(f"frame_id = {f}")).collect()}
        assert all(got[(g, d)] == alone[(f, d)] for g in range(f, 60, 3) for d in range(5))


def test_only_the_brightest_of_a_frame_are_looked_for_in_waves(spark, tmp_path, monkeypatch):
    for t in ("part", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").where("c_custkey < 25" if t == "customer" else "true").write.parquet(f"{tmp_path}/{t}.parquet")
    every = sorted(map(tuple, camera.planted(spark, str(tmp_path)).where("det_idx < 12").collect()))
    for first in (150, 900, 5000):  # some frames need several waves; one wave holds all stars
        assert sorted(map(tuple, camera.planted(spark, str(tmp_path), most=12, first=first).collect())) == every


def test_poses_of_arrays_are_those_of_pairs(spark):
    rng = random.Random(9)
    rows = [(k, [[rng.gauss(0, 1) for _ in range(3)] for _ in range(4)], [[rng.gauss(0, 1) for _ in range(3)] for _ in range(4)]) for k in range(30)]
    held = spark.createDataFrame(rows, "cand long, a array<struct<x:double,y:double,z:double>>, b array<struct<x:double,y:double,z:double>>")
    pairs = spark.createDataFrame([(k, *p, *q) for k, a, b in rows for p, q in zip(a, b, strict=True)], "cand long, bx double, by double, bz double, nx double, ny double, nz double")
    want = {r["cand"]: [r[c] for c in attitude.R] for r in attitude.wahba(pairs, ["cand"]).collect()}
    got = {r["cand"]: [r[c] for c in attitude.R] for r in attitude.wahba_of_arrays(held, "a", "b", 4).collect()}
    assert got.keys() == want.keys() and all(math.isclose(x, y, abs_tol=1e-9) for k in want for x, y in zip(want[k], got[k], strict=True))


def test_frames_are_not_put_into_few_tasks_by_their_size(spark):
    """Stored pixels are small and the work on a frame is not: adaptive execution must leave the tasks as many as they are."""
    rows = spark.range(40).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p"))
    pixels = scratch.stored(rows.select("frame_id", (F.col("p") / 16).cast("int").alias("y"), (F.col("p") % 16).cast("int").alias("x"), (F.col("p") % 7).cast("double").alias("v")), "frames")
    spots = scratch.stored(spark.range(40).select(F.col("id").alias("frame_id"), F.lit(0).cast("long").alias("det_idx"), F.lit(8.0).alias("x"), F.lit(8.0).alias("y")), "spots")
    found = images.iterate_centroids(pixels, spots)
    assert found.count() == 40 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_copies_and_pixels_are_not_broadcast(spark):
    """What is made of a small file may be large: the driver must not hold it."""
    pixels = scratch.stored(spark.range(4).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p")).select("frame_id", (F.col("p") / 16).cast("int").alias("y"), (F.col("p") % 16).cast("int").alias("x"), (F.col("p") % 7).cast("double").alias("v")), "frames")
    rects = scratch.stored(spark.range(4).select(F.col("id").alias("frame_id"), F.lit(0).alias("label"), *[F.lit(v).alias(c) for c, v in (("x1", 2), ("y1", 3), ("x2", 9), ("y2", 10))]), "rects")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rings = images.ring_centroids(pixels, rects)
    assert rings.count() == 4 and "Broadcast" not in plan(rings) and plan(rings).count("SortMergeJoin") == 1, "pixels meet rectangles once"
    points = lambda p: pixels.select("frame_id", F.col("x").cast("double").alias(f"{p}x"), F.col("y").cast("double").alias(f"{p}y"))
    assert "Broadcast" not in plan(joins.frame_join(points("l"), points("r"), 2.0, 2.0, ["frame_id"]))
    assert "Broadcast" not in plan(images.opening(pixels.select("frame_id", "y", "x"), pixels.groupBy("frame_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))).split("Generate")[0]


def test_frames_flattened_together_are_those_flattened_alone(spark, monkeypatch):
    rng = random.Random(4)
    shapes = [(20, 33), (20, 33), (1, 7), (40, 18), (20, 33), (5, 1)]
    rows = [(f, y, x, rng.randrange(256)) for f, (h, w) in enumerate(shapes) for y in range(h) for x in range(w) if f != 1 or (y + x) % 5]  # a frame with holes
    rng.shuffle(rows)
    pixels = spark.createDataFrame(rows, "frame_id long, y int, x int, v int")
    calls = lambda: sorted(map(tuple, images.flattened(pixels, True).collect()))
    alone = sorted(tuple(r) for f in range(len(shapes)) for r in images.flattened(pixels.where(f"frame_id = {f}"), True).collect())
    assert calls() == alone and len(alone) == len(rows)
    table = pixels.orderBy("frame_id").toArrow()
    assert sorted(len(grid) for _, grid, _ in images._stacks(table, "v")) == [1, 1, 1, 3]
    cut = list(images.whole_frames(table.to_batches(max_chunksize=100), 300))
    assert len(cut) > 3 and sorted(f for t in cut for f in set(t["frame_id"].to_pylist())) == list(range(len(shapes)))


def test_stars_are_drawn_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    y, x, light = rng.uniform(0, 40, 300), rng.uniform(0, 50, 300), rng.uniform(10, 9000, 300)
    want = np.full((40, 50), 300.0)
    for cy, cx, top in zip(y, x, light, strict=True):
        y1, x1 = max(0, int(cy) - 6), max(0, int(cx) - 6)
        ys, xs = np.ogrid[y1 : min(40, int(cy) + 7), x1 : min(50, int(cx) + 7)]
        want[y1 : y1 + len(ys), x1 : x1 + xs.size] += top * np.exp(-((ys + 0.5 - cy) ** 2 + (xs + 0.5 - cx) ** 2) / 2.4)
    monkeypatch.setattr(camera, "DRAWN", 70)
    got = np.full((40, 50), 300.0)
    camera._draw(got, y, x, light)
    assert np.allclose(got, want, rtol=1e-12)


def test_shots_are_drawn_by_many_tasks_and_copied_instead_of_stars(spark, monkeypatch):
    monkeypatch.setattr(camera, "SHOTS_A_TASK", 1)
    made = camera.rendered(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ObjectHashAggregate" not in plan, "a shot's stars are dealt once, as plain rows"
    files = made.collect()
    assert made.rdd.getNumPartitions() == len(files) == len({f["file"] for f in files}) == 10
    rot = camera._rotations(spark, "/root/testdata/sf0.001")
    stars = fixtures.frame(spark, "/root/testdata/sf0.001", "stars").select("star_idx", "mag", "x", "y", "z")
    a, b = (sorted(map(tuple, camera._in_frames(rot, stars, few).collect())) for few in (False, True))
    assert a == b and a
