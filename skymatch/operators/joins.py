"""Neighbourhood and range joins as equi-joins on cells and bins.

Spark would plan a bare distance or range condition as a nested loop. Here one
side is copied to the neighbouring cells (27 on the sphere, 4 in a frame, or
the bins of a range), both sides meet by equality, and the exact condition
filters. Adaptive execution splits cells that are hot.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def sphere_join(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """Rows of unit vectors (lx, ly, lz) and (rx, ry, rz) whose chord may be at most ``radius``: a superset to filter.

    ``on`` names further key columns that both sides have and must agree on.
    """
    size = max(radius, 1e-6)
    cells = lambda p: [F.floor(F.col(f"{p}{c}") / size) for c in "xyz"]
    a = left.withColumns(dict(zip(("_cx", "_cy", "_cz"), cells("l"), strict=True))).hint("merge")  # copies are not in Spark's estimate of size: it would broadcast them
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    b = right.withColumns(dict(zip(("_cx", "_cy", "_cz"), cells("r"), strict=True)))
    for c in ("_cx", "_cy", "_cz"):
        b = b.withColumn("_d", F.explode(near)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    return a.join(b, [*(on or []), "_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz")


#: Half of the 27 cells around a cell, itself first: of two cells that touch, one has the other in it.
_HALF = [(0, 0, 0), *[d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]]


def self_join(stars: DataFrame, radius: float, carried: list[str]) -> DataFrame:
    """Each pair of rows (star_idx, x, y, z) that may be within ``radius`` once, in either order: ``star_idx`` and ``carried`` with the prefixes l and r."""
    size = max(radius, 1e-6)
    cells = stars.select("star_idx", *carried, *[F.floor(F.col(c) / size).alias(f"_c{c}") for c in "xyz"])
    named = lambda p: cells.withColumnsRenamed({c: f"{p}{c}" for c in ("star_idx", *carried)})
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(step, "xyz", strict=True)]) for step in _HALF])
    other = named("r").withColumn("_d", F.explode(steps)).withColumn("_own", (F.col("_d.x") == 0) & (F.col("_d.y") == 0) & (F.col("_d.z") == 0))
    other = other.withColumns({f"_c{c}": F.col(f"_c{c}") + F.col(f"_d.{c}") for c in "xyz"}).drop("_d")
    met = named("l").hint("merge").join(other, ["_cx", "_cy", "_cz"])
    return met.where(~F.col("_own") | (F.col("lstar_idx") < F.col("rstar_idx"))).drop("_own", "_cx", "_cy", "_cz")


def reached(right: DataFrame, size: float) -> DataFrame:
    """Points (rx, ry) copied to the cells ``_cx, _cy``, of side 2 * ``size``, that hold what is within ``size`` of them: two an axis, three for a point on a seam."""
    side = 2 * size
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - size) / side), F.floor((F.col(c) + size) / side)))
    return right.withColumn("_cx", near("rx")).withColumn("_cy", near("ry"))


def frame_join(left: DataFrame, right: DataFrame, radius: Column | float, size: float, on: list[str]) -> DataFrame:
    """Rows of points (lx, ly) and (rx, ry) with equal ``on`` that are nearer than ``radius`` (at most ``size``)."""
    side = 2 * size
    a = left.withColumn("_cx", F.floor(F.col("lx") / side)).withColumn("_cy", F.floor(F.col("ly") / side))
    b = reached(right, size).hint("merge")  # as in `sphere_join`
    met = a.join(b, [*on, "_cx", "_cy"]).drop("_cx", "_cy")
    return met.where(F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")) < radius)


def neighbours(stars: DataFrame, radius: float, vectors: bool = False) -> DataFrame:
    """``(i, j, chord)`` with i < j for stars within the chord ``radius``, inclusive; with ``vectors`` also lx, ly, lz of i and rx, ry, rz of j."""
    met = self_join(stars, radius, ["x", "y", "z"]).withColumn("chord", g.chord(g.vec("l"), g.vec("r"))).where(F.col("chord") <= radius)
    i, j = F.least("lstar_idx", "rstar_idx").alias("i"), F.greatest("lstar_idx", "rstar_idx").alias("j")
    turned = F.col("lstar_idx") > F.col("rstar_idx")
    more = [F.when(turned, F.col(f"{q}{c}")).otherwise(F.col(f"{p}{c}")).alias(f"{p}{c}") for p, q in ("lr", "rl") for c in "xyz"] if vectors else []
    return met.select(i, j, "chord", *more)


def pairs_band(stars: DataFrame, low: float, high: float) -> DataFrame:
    """``(i, j, dist)``: star pairs i < j whose great-circle distance is in [low, high]. Needs star_idx, ra, dec and x, y, z."""
    if not 0 <= low < high <= math.pi:
        raise ValueError("need 0 <= low < high <= pi")
    reach = 2 * math.sin(high / 2)
    met = self_join(stars, reach + 1e-6, ["ra", "dec", "x", "y", "z"])
    met = met.where(g.dot(g.vec("l"), g.vec("r")) > 1 - (reach + 1e-6) ** 2 / 2 - 1e-7)  # a cheap look before the exact distance
    i, j = F.least("lstar_idx", "rstar_idx").alias("i"), F.greatest("lstar_idx", "rstar_idx").alias("j")
    return met.select(i, j, g.great_circle("lra", "ldec", "rra", "rdec").alias("dist")).where(F.col("dist").between(low, high))


def cones(centres: DataFrame, stars: DataFrame, radius: float, few: bool = False) -> DataFrame:
    """Stars strictly within ``radius`` of the unit vectors of ``centres`` (x, y, z and any keys); brightest order is star_idx.

    With ``few`` the centres are copied to the neighbouring cells, not the stars.
    """
    named = lambda df, a, b: df.withColumnsRenamed({f"{a}{c}": f"{b}{c}" for c in "xyz"})
    reach = 2 * math.sin(radius / 2) + 1e-9
    if few:
        met = sphere_join(named(stars, "", "l"), named(centres, "", "r"), reach)
        met = named(named(named(met, "l", "_"), "r", "l"), "_", "r")
    else:
        met = sphere_join(named(centres, "", "l"), named(stars, "", "r"), reach)
    return met.where(g.dot(g.vec("l"), g.vec("r")) > math.cos(radius))


def first_matches(met: DataFrame, frame: list[str], image: str, catalogue: str) -> DataFrame:
    """One-to-one matches: the first catalogue index of each image index, then the first image index of each of those.

    A match that the second step removes is not offered again.
    """
    once = met.groupBy(*frame, image).agg(F.min(catalogue).alias(catalogue))
    return once.groupBy(*frame, catalogue).agg(F.min(image).alias(image))
