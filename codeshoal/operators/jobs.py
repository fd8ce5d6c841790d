"""Jobs and repositories: order, progress, latest status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C


def by_priority(jobs: DataFrame, id_column: str = "id") -> DataFrame:
    """Jobs in the order to run: priority 1 first, then oldest."""
    return jobs.orderBy("priority", "created_at", id_column)


def filter_status(rows: DataFrame, status: str | None) -> DataFrame:
    return rows.filter(F.col("status") == status) if status else rows


def lookup(rows: DataFrame, requested: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids with their rows; ``found`` is false for missing ones."""
    return requested.select(key).join(
        rows.withColumn("found", F.lit(True)), key, "left"
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def progress(items: DataFrame, *keys: str) -> DataFrame:
    """Analyzed and total items with the whole percentage."""
    counted = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "completed").alias("analyzed_files"),
    )
    return counted.withColumn(
        "percentage",
        F.floor(F.col("analyzed_files") * 100 / F.greatest(F.lit(1), F.col("total_files")))
        .cast("int"),
    )


def latest_status(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest status per job, by time and then event id.

    max over a struct aggregates partially, so a job with very many events
    sends one row per task.
    """
    last = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy(key).agg(last.alias("l")).select(
        key, F.col("l.status").alias("status"), F.col("l.event_id").alias("event_id"),
        F.col("l.status").isin(*C.TERMINAL_STATUSES).alias("is_final"),
    )
