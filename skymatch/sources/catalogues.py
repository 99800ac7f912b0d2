"""Star catalogues as DataFrames. Files are read by Spark's own readers and decoded in tasks."""

from __future__ import annotations

import io
import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Fixed layout of a Bright Star Catalogue record.
BSC5_RECORD = np.dtype([("id", "<f4"), ("ra", "<f8"), ("dec", "<f8"), ("type", "<i2"), ("mag", "<i2"), ("pm_ra", "<f4"), ("pm_dec", "<f4")])


def read_bsc5(spark: SparkSession, path: str, max_mag: float = 99.0, epoch: float | None = None) -> DataFrame:
    """``(cat_id, ra, dec, mag)`` of binary Bright Star Catalogue files; with ``epoch`` moved there from J2000 or B1950.

    A header of seven 32-bit integers comes first; a negative star count means
    J2000. A file whose header asks for another layout is read with a warning.
    """

    def decode(batches):
        for pdf in batches:
            for content in pdf.content:
                head = np.frombuffer(content[:28], "<i4")
                if list(head[3:7]) != [1, 1, 1, 32]:
                    warnings.warn("unexpected catalogue header", stacklevel=1)
                rows = np.frombuffer(content[28 : 28 + abs(int(head[2])) * 32], BSC5_RECORD)
                yield pd.DataFrame({"cat_id": rows["id"].astype("i8"), "ra": rows["ra"], "dec": rows["dec"], "mag": rows["mag"] / 100, "pm_ra": rows["pm_ra"].astype("f8"), "pm_dec": rows["pm_dec"].astype("f8"), "origin": 2000.0 if head[2] < 0 else 1950.0})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "cat_id long, ra double, dec double, mag double, pm_ra double, pm_dec double, origin double")
    rows = rows.where((F.col("mag") <= max_mag) & ((F.col("ra") != 0) | (F.col("dec") != 0)))
    if epoch is not None:
        scale = 180 / math.pi * 3.6e6  # the file has radians a year
        ra, dec = g.proper_motion(F.col("ra"), F.col("dec"), F.col("pm_ra") * scale, F.col("pm_dec") * scale, F.lit(float(epoch)) - F.col("origin"))
        rows = rows.withColumns({"ra": ra, "dec": dec})
    return rows.select("cat_id", "ra", "dec", "mag")


def read_pipe(spark: SparkSession, path: str, id_field: int = 1) -> DataFrame:
    """Raw text columns ``cat_id, mag, ra_deg, dec_deg, pm_ra, pm_dec`` of a pipe-delimited catalogue, for `catalogue.read_rows`."""
    names = {id_field: "cat_id", 5: "mag", 8: "ra_deg", 9: "dec_deg", 12: "pm_ra", 13: "pm_dec"}
    fields = F.split("value", r"\|")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.trim(F.get(fields, k)).alias(n) for k, n in names.items()])


def read_npz(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``stars`` and ``patterns(stars)`` of databases stored as NumPy archives; empty slots of the pattern table are dropped."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def stars(batches):
        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    t = z["star_table"].astype("f8")
                    ids = z["star_catalog_IDs"] if "star_catalog_IDs" in z else None
                ids = [[int(v) for v in np.atleast_1d(i)] for i in ids] if ids is not None else [None] * len(t)
                yield pd.DataFrame({"star_idx": np.arange(len(t)), "cat_ids": ids, **dict(zip(("ra", "dec", "x", "y", "z", "mag"), t.T, strict=True))})

    def patterns(batches):
        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    p = z["pattern_catalog"].astype("i8")
                    edge = z["pattern_largest_edge"].astype("f8") / 1000 if "pattern_largest_edge" in z else np.full(len(p), np.nan)
                held = p.any(axis=1)
                yield pd.DataFrame({"stars": list(p[held]), "largest_edge": pd.array(edge[held]).astype("Float64")})

    return files.mapInPandas(stars, "star_idx long, cat_ids array<long>, ra double, dec double, x double, y double, z double, mag double"), files.mapInPandas(patterns, "stars array<long>, largest_edge double")


#: Properties of a database: fixed names of the format, and the older names or the values that stand for those missing.
PROPERTIES = (
    "pattern_mode pattern_size pattern_bins pattern_max_error max_fov min_fov star_catalog epoch_equinox epoch_proper_motion pattern_stars_per_fov"
    " verification_stars_per_fov star_max_magnitude simplify_pattern range_ra range_dec presort_patterns"
).split()
OLDER = {"verification_stars_per_fov": "catalog_stars_per_fov", "star_max_magnitude": "star_min_magnitude"}
MISSING = {"presort_patterns": "False", "star_catalog": "unknown"}


def read_npz_properties(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, value)``, values as text: every property of databases stored as NumPy archives; null if one is missing and nothing stands for it."""

    def properties(batches):
        for pdf in batches:
            for name, content in zip(pdf.file, pdf.content, strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    packed = z["props_packed"]
                held = {k: packed[k][()] for k in packed.dtype.names}
                found = {k: held.get(k, held.get(OLDER.get(k, k), MISSING.get(k))) for k in PROPERTIES}
                if found["min_fov"] is None:
                    found["min_fov"] = found["max_fov"]
                values = [None if v is None else str(v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v) for v in found.values()]
                yield pd.DataFrame({"file": name, "key": list(found), "value": values})

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInPandas(properties, "file string, key string, value string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(cat_id, ra, dec, mag)`` of a headed CSV in radians."""
    return spark.read.csv(path, header=True, schema="cat_id long, ra double, dec double, mag double")
