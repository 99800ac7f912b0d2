"""Structured Streaming over centroid files and camera events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.frames import parse_centroids


def centroid_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of rows (file, value), one for each new text file in a folder."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), "value")


def identify_stream(files: DataFrame, identify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start identifying each batch of new files; results are appended to ``out`` as Parquet, by batch.

    ``identify`` takes detections (frame_id, det_idx, x, y), as `kvector.vote`
    and `solver.solve` do; frame_id is a hash of the file's name. A batch that
    is repeated after a failure replaces its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = parse_centroids(batch).where("x is not null").withColumn("frame_id", F.xxhash64("file"))
        identify(rows.select("frame_id", "det_idx", "x", "y")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def camera_activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value by camera kind and tumbling window of event time; a watermark bounds the state."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return held.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
