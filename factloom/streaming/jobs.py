"""A polled job queue: new JSON files of jobs are taken as they come, each claimed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

JOB = "job string, kind string, payload string, submitted timestamp"


def watch_jobs(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Start a query that gives each batch of new jobs, every job once within an hour of its time, to ``handle``."""
    jobs = spark.readStream.schema(JOB).json(folder).withWatermark("submitted", "1 hour").dropDuplicatesWithinWatermark(["job"])
    writer = jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
