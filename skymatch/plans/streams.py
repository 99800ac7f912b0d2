"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import shared_folder
from ..streaming.frames import camera_activity
from .registry import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/skymatch/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")  # a batch that is repeated replaces itself

    run = camera_activity(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    # a window may be updated by several batches; its last state counts
    rows = spark.read.parquet(f"{place}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return rows.select("start", "event_type", "s.n", F.round("s.total", 4).alias("total"))
