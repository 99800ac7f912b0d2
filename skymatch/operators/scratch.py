"""Tables that are read more than once are written to the shared folder in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many narrow rows may be broadcast; callers count first.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a new local one only where it is unset on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skymatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and read back; this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skymatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a counted small side; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
