"""Streaming forms of the incremental operators: file scans, feedback and the guarded pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FEEDBACK_SCHEMA = (
    "id string, search_event_id string, track_id string, rating int, note string, created_at timestamp_ntz, ingested_at timestamp_ntz"
)


def feedback_stream(spark: SparkSession, folder: str, schema: str = FEEDBACK_SCHEMA) -> DataFrame:
    """Feedback files as they arrive; rows delivered twice with the same id come out once within the late-data bound."""
    rows = spark.readStream.schema(schema).parquet(folder)
    timed = rows.withColumn("event_time", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("event_time", "60 days").dropDuplicatesWithinWatermark(["id"])


def latest_ratings(stream: DataFrame) -> DataFrame:
    """(track_id, rating, ratings): the last rating of each track; state is one row per track."""
    clamped = F.least(F.greatest(F.col("rating"), F.lit(-1)), F.lit(1))
    rated = stream.where(F.col("rating").isNotNull() & F.col("track_id").isNotNull())
    return rated.groupBy("track_id").agg(
        F.max_by(clamped, F.struct("created_at", "id")).alias("rating"), F.count(F.lit(1)).alias("ratings")
    )


def ratings_per_window(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, ratings, mean): ratings per event-time window, late ones accepted up to a bound."""
    rated = stream.where(F.col("rating").isNotNull()).withColumn("event_time", F.col("created_at").cast("timestamp"))
    return rated.withWatermark("event_time", late).groupBy(F.window("event_time", width)).agg(
        F.count(F.lit(1)).alias("ratings"), F.avg("rating").alias("mean")
    )


def run_incremental(
    source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run ``step`` for each batch that holds rows: what is available now, or again and again every so often.

    A batch without rows does not start the steps behind it.
    """

    def guarded(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            step(batch, number)

    writer = source.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def cancel_group(spark: SparkSession, group: str) -> None:
    """Stop the running jobs of a group."""
    spark.sparkContext.cancelJobGroup(group)
