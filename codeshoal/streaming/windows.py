"""Event-time aggregations that run on batch and streaming tables alike.

On a stream, rows later than the watermark are dropped; how many were is in
the progress metric numRowsDroppedByWatermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def task_counts(tasks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tasks per window, type and status."""
    return (
        watermarked(tasks, delay)
        .groupBy(F.window("ts", width).alias("w"), "task_type", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "task_type", "status", "n")
    )


def alert_windows(
    requests: DataFrame,
    is_error: Column,
    duration: str = "duration_s",
    width: str = "1 hour",
    delay: str = "10 minutes",
    max_error_rate: float = 0.05,
    max_p99: float = 2.0,
) -> DataFrame:
    """Windows whose error rate or p99 latency is above its limit.

    p99 is exact: the state of a window counts each distinct latency, so it grows with the
    distinct values of the window, not with its requests.
    """
    p99 = F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY `{duration}`)")
    measured = (
        watermarked(requests, delay)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_error).alias("errors"),
            p99.alias("p99"),
        )
        .withColumn("error_rate", F.col("errors") / F.col("n"))
    )
    return measured.filter(
        (F.col("error_rate") > max_error_rate) | (F.col("p99") > max_p99)
    ).select(
        F.col("w.start").alias("window_start"), "n", "errors", "error_rate", "p99",
        (F.col("error_rate") > max_error_rate).alias("error_alert"),
        (F.col("p99") > max_p99).alias("latency_alert"),
    )


def queue_flow(
    events: DataFrame, enqueued: Column, dequeued: Column,
    width: str = "1 minute", delay: str = "10 minutes",
) -> DataFrame:
    """Net growth of a queue per window."""
    return (
        watermarked(events, delay)
        .groupBy(F.window("ts", width).alias("w"))
        .agg((F.count_if(enqueued) - F.count_if(dequeued)).alias("net"))
        .select(F.col("w.start").alias("window_start"), "net")
    )


def throughput(
    requests: DataFrame, service: str = "service", delay: str = "10 minutes"
) -> DataFrame:
    """Requests per second and service, averaged over the seconds of each minute."""
    per_second = (
        watermarked(requests, delay)
        .groupBy(F.window("ts", "1 second").alias("w"), service)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_second.groupBy(F.window(F.window_time("w"), "1 minute").alias("m"), service)
        .agg(F.sum("n").alias("requests"), F.max("n").alias("peak_per_second"))
        .select(
            F.col("m.start").alias("minute"), service, "requests", "peak_per_second",
            (F.col("requests") / 60.0).alias("requests_per_second"),
        )
    )


def task_durations(
    events: DataFrame, max_hours: int = 24, delay: str = "1 hour"
) -> DataFrame:
    """Duration of each task from its start and finish events.

    Both sides carry a watermark and the join bounds the time between them, so
    a stream can forget starts that can no longer be finished.
    """
    def side(phase: str) -> DataFrame:
        rows = watermarked(events.filter(F.col("phase") == phase), delay)
        return rows.select(
            F.col("task_id").alias(f"{phase}_id"), F.col("ts").alias(f"{phase}_ts"), "task_type",
        ) if phase == "start" else rows.select(
            F.col("task_id").alias(f"{phase}_id"), F.col("ts").alias(f"{phase}_ts")
        )

    start, finish = side("start"), side("finish")
    return start.join(
        finish,
        (F.col("start_id") == F.col("finish_id"))
        & (F.col("finish_ts") >= F.col("start_ts"))
        & (F.col("finish_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {max_hours} HOURS")),
    ).select(
        F.col("start_id").alias("task_id"), "task_type", "start_ts",
        ((F.unix_micros("finish_ts") - F.unix_micros("start_ts")) / 1e6).alias("duration_s"),
    )


def debounced(
    edits: DataFrame, key: str = "document", gap: str = "1 second", delay: str = "10 seconds"
) -> DataFrame:
    """The last edit of each burst: one row once a document has been quiet."""
    return (
        watermarked(edits, delay)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(
            F.max(F.struct("ts", "event_id")).alias("l"),
            F.count(F.lit(1)).alias("edits"),
        )
        .select(
            key, F.col("w.start").alias("first_ts"), F.col("l.ts").alias("last_ts"),
            F.col("l.event_id").alias("event_id"), "edits",
        )
    )
