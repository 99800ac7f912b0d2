import math

import numpy as np
from pyspark.sql import functions as F
from skymatch.functions import geometry as g
from skymatch.operators import attitude


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(float(x), float(y)) for x in (1, 160, 319) for y in (1, 120, 239)], "x double, y double")
    v = g.pixel_vector("x", "y", 320, 240, 0.4)
    px, py = g.vector_pixel(v, 320, 240, 0.4)
    for r in rows.select("x", "y", px.alias("px"), py.alias("py"), g.norm(v).alias("n")).collect():
        assert abs(r["px"] - r["x"]) < 1e-9 and abs(r["py"] - r["y"]) < 1e-9 and abs(r["n"] - 1) < 1e-12
    r = one(spark, x=g.vector_pixel(tuple(map(F.lit, (0.0, 1.0, 0.0))), 320, 240, 0.4)[0])
    assert r["x"] is None


def test_distortion_round_trip_and_centre(spark):
    rows = spark.createDataFrame([(160.0, 120.0), (10.0, 20.0), (300.0, 200.0)], "x double, y double")
    for k in (-0.2, 0.0, 0.1, None):
        ux, uy = g.undistort("x", "y", 320, 240, F.lit(k).cast("double"))
        dx, dy = g.distort(ux, uy, 320, 240, F.lit(k).cast("double"), 20)
        for r in rows.select("x", "y", dx.alias("a"), dy.alias("b")).collect():
            assert abs(r["a"] - r["x"]) < 1e-6 and abs(r["b"] - r["y"]) < 1e-6


def test_rotation_angles_and_quaternion(spark):
    angles = [(a, b, c) for a in (0.0, 1.0, 3.0, 5.5) for b in (-1.4, 0.0, 1.2) for c in (0.0, 2.0, 3.1)]
    rows = spark.createDataFrame(angles, "ra double, dec double, roll double")
    rot = rows.select("ra", "dec", "roll", *[c.alias(n) for c, n in zip(g.rotation("ra", "dec", "roll"), attitude.R, strict=True)])
    r9 = [F.col(c) for c in attitude.R]
    back = rot.select("*", *[c.alias(n) for c, n in zip(g.attitude_angles(r9), ("ra2", "dec2", "roll2"), strict=True)], F.array(*g.quaternion(r9)).alias("q"))
    for r in back.collect():
        for a, b in (("ra", "ra2"), ("roll", "roll2")):
            assert abs((math.degrees(r[a]) - r[b] + 180) % 360 - 180) < 1e-6
        assert abs(math.degrees(r["dec"]) - r["dec2"]) < 1e-6
        w, x, y, z = r["q"]
        m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        want = np.array([r[c] for c in attitude.R]).reshape(3, 3)
        assert w >= 0 and (np.allclose(m, want, atol=1e-7) or np.linalg.det(want) < 0)


def test_mismatch_probability_is_a_binomial_tail(spark):
    rows = [(m, n, p) for n in (0, 4, 14) for m in range(n + 1) for p in (0.001, 0.2, 1.0, 1.5)]
    got = spark.createDataFrame(rows, "m long, n long, p double").select("*", g.mismatch_probability(F.col("m"), F.col("n"), F.col("p")).alias("q")).collect()
    for r in got:
        m, n, p = r["m"], r["n"], r["p"]
        if m <= 2:
            assert r["q"] == 1.0
        elif p > 1:
            assert r["q"] is None
        else:
            want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m - 2, n + 1))
            assert abs(r["q"] - want) <= 1e-9 * max(want, 1e-300) + 1e-18


def test_codes_keys_and_ladder(spark):
    r = one(spark, key=g.code_key(F.array(*map(F.lit, (3, 1, 4, 1, 5))), 50), slot=g.table_index(F.lit(123456789012).cast("long"), F.lit(1000003)))
    assert r["key"] == 3 + 50 * (1 + 50 * (4 + 50 * (1 + 50 * 5))) and r["slot"] == 123456789012 * 2654435761 % 2**64 % 1000003
    assert g.fov_ladder(75, 70) == [75] and len(g.fov_ladder(75, 60)) == 2 and abs(g.fov_ladder(30, 10)[-1] - 10) < 1e-9
    r = one(spark, a=g.chord_angle(F.lit(2.0000000001)), b=g.clamp_dot(F.lit(1.5)), d=g.distance_bin(F.lit(0.5), 0.0, 0.5, 10))
    assert abs(r["a"] - math.pi) < 1e-9 and r["b"] == 1.0 and r["d"] == 9


def test_hat_and_triad(spark):
    a, b = tuple(map(F.lit, (1.0, 2.0, 3.0))), tuple(map(F.lit, (0.5, -1.0, 2.0)))
    r = one(spark, h=F.array(*g.hat(a)), u=F.array(*g.unhat(g.hat(a))), c=F.array(*g.cross(a, b)), flat=F.array(*g.triad(a, a, a, b)), same=F.array(*g.triad(a, b, a, b)), none=F.array(*g.normalize(tuple(map(F.lit, (0.0, 0.0, 0.0))))))
    assert r["u"] == [1.0, 2.0, 3.0] and np.allclose(np.array(r["h"]).reshape(3, 3) @ [0.5, -1, 2], r["c"])
    assert r["flat"] == [None] * 9 and np.allclose(np.array(r["same"]).reshape(3, 3), np.eye(3)) and r["none"] == [None] * 3
