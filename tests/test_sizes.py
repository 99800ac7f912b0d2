"""Steps that must not grow faster than their input: what is shuffled, broadcast or left to one task."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skymatch.operators import catalogue, images, joins, kvector, tiles
from skymatch.plans import camera, frames, registry, sky  # noqa: F401  importing registers the queries

DATA = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sky(spark, n: int, seed: int):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    v = np.round(v / np.linalg.norm(v, axis=1)[:, None], 9)
    return v, spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(v)], "star_idx long, x double, y double, z double")


@pytest.mark.parametrize("name", ["pattern_cliques", "edge_ratios", "pattern_codes"])
def test_patterns_are_not_joined_or_shuffled(spark, name):
    plan = _plan(registry.QUERIES[name](spark, DATA))
    assert sum(line.count("Join") for line in plan.splitlines()) == 1, "neighbours alone are joined"
    assert plan.index("MapInArrow") < plan.index("ObjectHashAggregate")


def test_near_patterns_equal_all_fours(spark):
    v, stars = _sky(spark, 60, 3)
    near = np.linalg.norm(v[:, None] - v[None], axis=2) <= 0.9
    want = [q for q in itertools.combinations(range(60), 4) if all(near[i, j] for i, j in itertools.combinations(q, 2))]
    rows = catalogue.near_patterns(stars, 0.9).collect()
    assert sorted((r.a, r.b, r.c, r.d) for r in rows) == want and len(want) > 100
    for r in rows:
        edges = sorted(2 * np.arcsin(np.linalg.norm(v[i] - v[j]) / 2) for i, j in itertools.combinations(r[:4], 2))
        assert np.allclose([*r[4:]], [*(e / edges[5] for e in edges[:5]), edges[5]], atol=1e-12)
    assert catalogue.near_patterns(stars, 1e-4).count() == 0
    counts = {r.code_key: r.patterns for r in catalogue.code_counts(stars, 0.9).collect()}
    assert sum(counts.values()) == len(want)


def test_patterns_found_some_at_a_time_are_the_same(monkeypatch):
    v = np.random.default_rng(5).normal(size=(30, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = pa.array([[{"j": j, "x": v[j, 0], "y": v[j, 1], "z": v[j, 2]} for j in range(29, 0, -1)]])
    batch = pa.record_batch([pa.array([0]), *(pa.array([v[0, k]]) for k in range(3)), near], ["a", "ax", "ay", "az", "near"])
    found = lambda: sorted(tuple(map(int, q)) for ids, _ in catalogue._gathered(catalogue._quads([batch], 1.2)) for q in zip(*ids, strict=True))
    whole = found()
    monkeypatch.setattr(catalogue, "PATTERNS", 7)
    assert found() == whole and len(whole) > 50


def test_count_around_equals_enumeration(spark):
    _, stars = _sky(spark, 80, 4)
    edges = joins.neighbours(stars, 0.6).select("i", "j")
    want = {r["star_idx"]: r["n"] for r in catalogue.stars_around(edges).groupBy(F.get("stars", 0).alias("star_idx")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["star_idx"]: int(r["patterns"]) for r in catalogue.count_around(edges).collect()} == want and want
    hub = spark.range(1, 3_000_001).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"))
    assert int(catalogue.count_around(hub).first()["patterns"]) == 3_000_000 * 2_999_999 * 2_999_998 // 6


@pytest.mark.parametrize("name", ["sky_cone", "project_to_pixels", "ball_query", "pairs_band", "cosine_lookup"])
def test_copies_for_neighbouring_cells_are_not_broadcast(spark, name):
    assert "Broadcast" not in _plan(registry.QUERIES[name](spark, DATA))


def test_self_join_meets_each_pair_once(spark):
    v, stars = _sky(spark, 150, 6)
    rows = joins.self_join(stars, 0.4, ["x"]).select("lstar_idx", "rstar_idx").collect()
    pairs = [tuple(sorted(r)) for r in rows]
    assert len(pairs) == len(set(pairs))
    near = {(i, j) for i, j in itertools.combinations(range(150), 2) if np.linalg.norm(v[i] - v[j]) <= 0.4}
    assert near and near <= set(pairs)


@pytest.mark.parametrize("name", ["crop", "threshold_mask", "noise_sigma", "crop_and_downsample"])
def test_pixels_are_made_by_many_tasks_and_not_broadcast(spark, name):
    plan = _plan(registry.QUERIES[name](spark, DATA))
    assert plan.count("BroadcastHashJoin") <= (name == "noise_sigma"), "but the two levels of a frame, a row each"
    assert plan.index("Generate explode") < plan.index("REPARTITION_BY_NUM"), "pixels are made after their frames were dealt"
    made = sky.frame(spark, DATA, "pixels")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.select(F.spark_partition_id()).distinct().count() > 1


def test_equal_ranges_are_looked_up_once(spark):
    pairs = spark.range(2000).select(F.col("id").alias("i"), F.col("id").alias("j"), (0.01 + F.col("id") * 0.00009).alias("dist"))
    pairs = pairs.withColumn("bin", sky.g.distance_bin(F.col("dist"), sky.LOW, sky.HIGH, sky.BINS))
    ranges = spark.range(600).select(F.col("id").alias("frame_id"), (0.01 + F.col("id") % 3 * 0.05).alias("lo")).withColumn("hi", F.col("lo") + 0.0015).withColumn("hi", F.when(F.col("frame_id") == 5, 0.5).otherwise(F.col("hi")))
    ask = lambda r: kvector.lookup(r, pairs, sky.LOW, sky.HIGH, sky.BINS)
    want = ask(ranges).groupBy("frame_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("dist").between(F.col("lo"), F.col("hi"))).alias("inside"))
    got = kvector.range_counts(ranges, pairs, sky.LOW, sky.HIGH, sky.BINS).select("frame_id", "found", "inside")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 599


@pytest.mark.parametrize("rows", [1, 7, 50_000])
def test_tiles_labelled_together_keep_their_blobs(spark, monkeypatch, rows):
    monkeypatch.setattr(tiles, "SIDE", 8)
    monkeypatch.setattr(tiles, "ROWS", rows)
    grid = np.random.default_rng(8).random((3, 20, 20)) < 0.4
    spots = [(int(f), int(y), int(x)) for f, y, x in np.argwhere(grid)]
    got = {(r.frame_id, r.y, r.x): r.label for r in images.components(spark.createDataFrame(spots, "frame_id long, y int, x int")).collect()}
    want = {}
    for f in range(3):
        y, x = np.nonzero(grid[f])
        want |= {(f, int(a), int(b)): int(k) for a, b, k in zip(y, x, images.blob_labels(y, x, False), strict=True)}
    assert got == want


def test_patterns_without_ratios_take_no_angles_and_distances_once(monkeypatch):
    v = np.random.default_rng(6).normal(size=(40, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = pa.array([[{"j": j, "x": v[j, 0], "y": v[j, 1], "z": v[j, 2]} for j in range(1, 40)]])
    batch = pa.record_batch([pa.array([0]), *(pa.array([v[0, k]]) for k in range(3)), near], ["a", "ax", "ay", "az", "near"])
    take = lambda edges: list(catalogue._gathered(catalogue._quads([batch], 1.2, edges)))
    ((ids, angles),) = take(True)
    assert (np.diff(np.stack(angles), axis=0) >= 0).all() and len(ids[0]) > 50
    taken, chords = [], catalogue._chords
    monkeypatch.setattr(catalogue, "_chords", lambda v, w: taken.append(v.shape) or chords(v, w))
    monkeypatch.setattr(catalogue, "_angles", None)
    ((alone, none),) = take(False)
    assert none is None and np.array_equal(alone, ids) and len(taken) == 1
    monkeypatch.setattr(catalogue, "WIDE", 10)
    ((alone, _),) = take(False)
    assert np.array_equal(alone, ids) and len(taken) > 10


def test_the_network_sorts_six_columns():
    bits = np.array(list(itertools.product((0, 1), repeat=6)))
    runs = [((0, 1, np.arange(64), np.arange(64)), 64, tuple(bits.T))]
    ((_, angles),) = catalogue._gathered(runs)
    assert np.array_equal(np.stack(angles, axis=1), np.sort(bits, axis=1)), "what sorts all zeros and ones sorts all numbers"
