"""Helpers that the operators of this subpackage share.

Tables that are read more than once are written as Parquet in the shared
folder named by ``spark.checkpoint.dir``. That cuts the lineage, survives the
loss of any executor, and is one pass of work (``checkpoint()`` computes its
input twice unless it is also cached).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of at most this many narrow rows may be broadcast; callers count first.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a new local one only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skymatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skymatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that goes to a Python worker, at most.
BATCH_ROWS = 1000


def batched(df: DataFrame) -> DataFrame:
    """``df``, and the session's Arrow batches held to `BATCH_ROWS`: the usual 10,000 whole texts are too much memory for a worker and its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` allow it; otherwise leave a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def number_within(df: DataFrame, key: str, out: str, order: list[str], level: Column | None = None, buckets: int = 1024) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each ``key``, without one task per key.

    Rows are dealt to ``buckets`` hash buckets of each key, numbered there, and
    moved up by the sizes of the buckets before. ``level`` (a small integer, if
    given) orders first, so rows of lower level get lower numbers. The table of
    bucket sizes has keys x levels x buckets rows, whatever the input's size.
    """
    level = F.lit(0) if level is None else level
    rows = df.withColumn("_level", level).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = rows.groupBy(key, "_level", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_level", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(key, "_level", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_level", "_bucket").orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(base), [key, "_level", "_bucket"]).withColumn(out, F.col("_base") + F.col("_i")).drop("_level", "_bucket", "_base", "_i")
