"""Writing findings, tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.upserts import retain, retention_counts

# Rows per file, so one very large repository is written as many files.
MAX_RECORDS_PER_FILE = 1_000_000


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned parquet by repository and finding type.

    Rows are brought together by partition and a hash of the path: a
    repository's findings land in few files, and a huge one is spread over
    several tasks instead of one.
    """
    salt = F.pmod(F.xxhash64("path"), F.lit(16))
    (
        findings.repartition(F.col("repo_id"), F.col("finding_type"), salt)
        .write.mode(mode)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("repo_id", "finding_type")
        .parquet(path)
    )


def export_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a report as JSON or CSV; nested columns become JSON text in CSV."""
    if fmt == "json":
        report.write.mode("overwrite").json(path)
    elif fmt == "csv":
        flat = report.select(
            *[
                F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct"))
                else F.col(name)
                for name, kind in report.dtypes
            ]
        )
        flat.write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError("format is json or csv")
    return path


def rewrite_retained(
    df: DataFrame, path: str, ts: str, as_of: Column, max_age_days: int = 30
) -> int:
    """Write the rows young enough to a new path; returns how many were dropped.

    The source is not touched: swap the paths once the write has succeeded.
    """
    retain(df, ts, as_of, max_age_days).write.mode("overwrite").parquet(path)
    return retention_counts(df, ts, as_of, max_age_days).first()["deleted_count"]


def write_bucketed(files: DataFrame, table: str, buckets: int) -> None:
    """Files clustered by file id, so later joins on it need no shuffle."""
    files.write.mode("overwrite").bucketBy(buckets, "file_id").sortBy("file_id").saveAsTable(table)
