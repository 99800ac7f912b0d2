"""Star-field tables derived from the given tables by arithmetic that Spark and DuckDB share.

Each is SQL over ``{table}`` placeholders: filled with views for Spark, and
used as common table expressions by the oracles. Doubles are rounded to nine
digits where trigonometry enters, for its last bit differs between engines.
Stars are scattered by polynomials modulo primes; steps by a constant would give a
sky that nearly repeats itself, in which patterns do not tell places apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STARS = """
    SELECT star_idx, cat_id, mag, ra, dec, round(cos(ra) * cos(dec), 9) AS x, round(sin(ra) * cos(dec), 9) AS y, round(sin(dec), 9) AS z FROM (
        SELECT CAST(p_size AS BIGINT) * 1000000000 + p_partkey AS star_idx, p_partkey AS cat_id, p_size / 6.25e0 AS mag,
            round(radians(((((p_partkey * p_partkey) % 999983) * (p_partkey % 4093 + 7) + p_partkey * 31) % 999983) / 999983e0 * 360e0), 9) AS ra,
            round(asin(2e0 * (((((p_partkey * p_partkey) % 1000003) * (p_partkey % 5003 + 11) + p_partkey * 17) % 1000003) / 1000003e0) - 1e0), 9) AS dec FROM {part}) q
"""
RAW = """
    SELECT p_partkey AS cat_id, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE CAST(p_size AS VARCHAR(9)) END AS mag,
        CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '0' ELSE CAST((p_partkey * 137) % 360 AS VARCHAR(9)) END AS ra_deg,
        CASE WHEN p_partkey % 13 = 0 THEN '0' ELSE CAST((p_partkey * 71) % 179 - 89 AS VARCHAR(9)) END AS dec_deg,
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST((p_partkey * 31) % 2000 - 1000 AS VARCHAR(9)) END AS pm_ra,
        CAST((p_partkey * 17) % 2000 - 1000 AS VARCHAR(9)) AS pm_dec FROM {part}
"""
DETECTIONS = """
    SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, x, y, ship, line) - 1 AS det_idx, x, y, intensity, channel FROM (
        SELECT l_orderkey AS frame_id, (CAST(round(l_extendedprice * 100e0, 0) AS BIGINT) % 32000) / 100e0 AS x, ((l_partkey * 7919 + l_suppkey * 104729) % 24000) / 100e0 AS y,
            l_quantity AS intensity, l_shipdate AS ship, l_linenumber AS line, l_returnflag AS channel FROM {lineitem}) q
"""
FRAMES = """
    SELECT c_custkey AS frame_id, round(radians((c_custkey * 73.13e0) % 360e0), 9) AS ra0, round(asin(1.8e0 * ((c_custkey * 0.5698402910e0) % 1e0) - 0.9e0), 9) AS dec0, round(radians((c_custkey * 41.37e0) % 360e0), 9) AS roll0 FROM {customer}
"""
#: Cameras that look at the planted sky and keep what they see as image files.
SHOTS = """
    SELECT s_suppkey AS frame_id, round(radians((s_suppkey * 57.31e0 + 11e0) % 360e0), 9) AS ra0, round(asin(1.8e0 * ((s_suppkey * 0.7548776662e0) % 1e0) - 0.9e0), 9) AS dec0, round(radians((s_suppkey * 29.17e0 + 5e0) % 360e0), 9) AS roll0 FROM {supplier}
"""
PIXELS = """
    SELECT s_suppkey AS frame_id, CAST(p / 32 AS INT) AS y, CAST(p % 32 AS INT) AS x,
        CAST(8 + (s_suppkey * 31 + p * 17 + (p * p) % 13) % 6
            + CASE WHEN abs(p % 32 - 6 - s_suppkey % 5) + abs(CAST(floor(p / 32e0) AS INT) - 9) <= 2 THEN 120 - 20 * abs(p % 32 - 6 - s_suppkey % 5) ELSE 0 END
            + CASE WHEN abs(p % 32 - 22) <= 1 + s_suppkey % 3 AND abs(CAST(floor(p / 32e0) AS INT) - 20 - s_suppkey % 4) <= 1 THEN 90 + s_suppkey % 7 ELSE 0 END
            + CASE WHEN p = 5 * 32 + 25 THEN 60 ELSE 0 END AS INT) AS v
    FROM (SELECT s_suppkey, CAST(p AS INT) AS p FROM (SELECT s_suppkey, {sequence} AS p FROM {supplier}) r) q
"""
#: Unit vectors from the first six components of the embeddings, two to a row.
DIRECTIONS = """
    SELECT vec_id, a1 / na AS ax, a2 / na AS ay, a3 / na AS az, b1 / nb AS bx, b2 / nb AS by_, b3 / nb AS bz FROM (
        SELECT *, sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS na, sqrt(b1 * b1 + b2 * b2 + b3 * b3) AS nb FROM (
            SELECT vec_id, CAST({e1} AS DOUBLE) AS a1, CAST({e2} AS DOUBLE) AS a2, CAST({e3} AS DOUBLE) AS a3, CAST({e4} AS DOUBLE) AS b1, CAST({e5} AS DOUBLE) AS b2, CAST({e6} AS DOUBLE) AS b3 FROM {embeddings}) p) q
    WHERE na > 0 AND nb > 0
"""
ALL = {"stars": (STARS, "part"), "raw": (RAW, "part"), "detections": (DETECTIONS, "lineitem"), "frames": (FRAMES, "customer"), "shots": (SHOTS, "supplier"), "pixels": (PIXELS, "supplier"), "directions": (DIRECTIONS, "embeddings")}


#: Frames whose pixels a task makes.
FRAMES_A_TASK = 1000


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` as a DataFrame."""
    text, source = ALL[name]
    fill = {f"e{k + 1}": f"embedding[{k}]" for k in range(6)} | {"sequence": "explode(sequence(0, 1023))"}
    for key, value in fill.items():
        text = text.replace("{" + key + "}", value)
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name == "pixels":  # a small file, one task by its size, makes 1,024 rows of each of its own; dealt by frame, what follows by frame needs no shuffle
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // FRAMES_A_TASK))  # a task's memory does not grow with the table
        rows = rows.repartition(parts, "s_suppkey")
    made = spark.sql(text, **{source: rows})
    return made.hint("merge") if name == "pixels" else made  # nor are those rows in Spark's estimate of size: it would broadcast them


def with_tables(*names: str) -> str:
    """The derived tables as the head of a DuckDB query."""
    fill = {f"e{k + 1}": f"embedding[{k + 1}]" for k in range(6)} | {"sequence": "unnest(range(0, 1024))"}
    out = []
    for name in names:
        text, source = ALL[name]
        for key, value in (fill | {source: source}).items():
            text = text.replace("{" + key + "}", value)
        text = text.replace("p / 32 AS INT", "p // 32 AS INT") if name == "pixels" else text
        out.append(f"{name} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(out) + "\n"
