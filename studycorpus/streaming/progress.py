"""Sync progress: one aggregation for streams and batches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V


def activity_fraction() -> Column:
    """Share of a course that an event stands for, from 0 to 1."""
    total = F.greatest(F.lit(0), F.coalesce("activity_total", F.lit(0)))
    given = F.coalesce(F.nullif("activity_index", F.lit(0)), F.lit(1))
    index = F.greatest(F.lit(1), F.least(total, given))
    share = F.when((F.col("bytes_total") > 0) & F.col("bytes_written").isNotNull(), F.least(
        F.lit(1.0), F.greatest(F.lit(0), F.col("bytes_written")) / F.col("bytes_total"))).otherwise(0.0)
    running = F.least(index / total, (index - 1 + share) / total)
    return F.when(total == 0, 0.0).when(F.coalesce("completed", F.lit(False)), index / total).otherwise(running)


def progress(events: DataFrame) -> DataFrame:
    """Fraction per course. It never falls, and stays below the end until the
    course itself is complete. Runs in update mode; a maximum needs no watermark.

    ``events``: course_id, activity_index, activity_total, bytes_written?,
    bytes_total?, completed (activity), course_complete.
    """
    capped = F.least(F.lit(V.ACTIVE_COURSE_MAX), activity_fraction())
    rows = events.select("course_id", capped.alias("_f"), F.coalesce("course_complete", F.lit(False)).alias("_done"))
    return (rows.groupBy("course_id").agg(F.max("_f").alias("active_fraction"), F.bool_or("_done").alias("complete"))
                .select("course_id", F.when(F.col("complete"), 1.0).otherwise(F.col("active_fraction")).alias("fraction"), "complete"))


def overall(progress_rows: DataFrame, total_courses: int | None = None) -> DataFrame:
    """One row: finished courses plus the running share, over all courses."""
    total = F.lit(total_courses) if total_courses is not None else F.count("*")
    return progress_rows.agg(
        F.count_if("complete").alias("completed"), total.alias("total"),
        F.least(F.lit(1.0), F.coalesce(F.sum("fraction"), F.lit(0.0)) / F.greatest(F.lit(1), total)).alias("overall"))


def start(events: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Run ``progress`` on a stream; every epoch writes its changed courses under
    its own number, so a repeated epoch overwrites itself."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = progress(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def latest(spark, path: str) -> DataFrame:
    """Current progress per course from the written epochs."""
    rows = spark.read.parquet(path)
    return rows.groupBy("course_id").agg(F.max("fraction").alias("fraction"), F.bool_or("complete").alias("complete"))
