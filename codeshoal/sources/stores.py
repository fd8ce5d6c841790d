"""Stored tables cut into buckets, so that a small batch rewrites only the buckets it touches.

A store is a Parquet folder with one partition folder per bucket, ``bucket`` being a hash of
the key modulo a fixed count.  A change reads the touched buckets alone (partition pruning),
works out their new rows, writes these beside the store and then lets dynamic partition
overwrite replace just those buckets.  Every change is idempotent: a run that was lost
half way is repeated whole, and a retried micro-batch leaves the same rows.  One writer at a time;
a reader that opened the store before a change should open it again after it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upserts import replace_by, upsert
from ..session import scratch_dir

BUCKET = "bucket"
# Choose it once for a table: a bucket should be some hundred MB when the table is full grown.
BUCKETS = 256


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a row by its key; a null key has one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a whole store; a table that was there is replaced.  No rows make an empty store."""
    _write(rows.withColumn(BUCKET, bucket_of(keys, buckets)), path, "static")
    # An empty file carries the schema where no bucket was written.
    rows.limit(0).write.mode("append").parquet(f"{path}/{BUCKET}=0")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a store, without their bucket."""
    return spark.read.parquet(path).drop(BUCKET)


def touched_buckets(changes: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """Buckets of the keys of a batch: at most ``buckets`` numbers, whatever the batch holds."""
    found = changes.select(bucket_of(keys, buckets).alias(BUCKET)).distinct()
    return sorted(row[BUCKET] for row in found.collect())


def read_buckets(spark: SparkSession, path: str, touched: Sequence[int]) -> DataFrame:
    """Rows of some buckets; the others' files are neither listed into tasks nor read."""
    return spark.read.parquet(path).where(F.col(BUCKET).isin(*touched))


def change_store(
    spark: SparkSession, path: str, touched: Sequence[int], change: Callable[[DataFrame], DataFrame]
) -> None:
    """Replace the touched buckets by what ``change`` makes of their rows.

    ``change`` gets the rows with their ``bucket`` and must keep a row's bucket.  Its rows take
    the store's columns and types, so that all buckets stay alike.  A bucket of which nothing
    is left becomes empty; it is cleared by an overwrite of its folder.
    """
    if not touched:
        return
    old = read_buckets(spark, path, touched)
    beside = scratch_dir(spark, "buckets")
    # Written first: a job cannot overwrite the files that it reads.
    change(old).to(old.schema).write.parquet(beside)
    fresh = spark.read.schema(old.schema).parquet(beside)
    held = {row[BUCKET] for row in fresh.select(BUCKET).distinct().collect()}
    if held:
        _write(fresh, path, "dynamic")
    for bucket in sorted(set(touched) - held):
        # No row names this partition, so dynamic overwrite would leave its old files.
        old.drop(BUCKET).limit(0).write.mode("overwrite").parquet(f"{path}/{BUCKET}={bucket}")


def upsert_store(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str],
    seq: str | None = None, buckets: int = BUCKETS,
) -> list[int]:
    """Merge a batch by key; the incoming side replaces all properties.  Returns the touched buckets."""
    touched = touched_buckets(incoming, keys, buckets)

    def merge(old: DataFrame) -> DataFrame:
        new = incoming.withColumn(BUCKET, bucket_of(keys, buckets))
        return upsert(old, new, keys, seq)

    change_store(spark, path, touched, merge)
    return touched


def replace_store(
    spark: SparkSession, path: str, fresh: DataFrame, changed: DataFrame, key: str,
    buckets: int = BUCKETS,
) -> list[int]:
    """Give the keys in ``changed`` the rows of ``fresh``; a key without any loses all it had."""
    touched = touched_buckets(changed, [key], buckets)

    def swap(old: DataFrame) -> DataFrame:
        new = fresh.withColumn(BUCKET, bucket_of([key], buckets))
        return replace_by(old, new, changed, key)

    change_store(spark, path, touched, swap)
    return touched


def _write(rows: DataFrame, path: str, mode: str) -> None:
    # Few files for a bucket, and more than one task for a bucket that a hot key makes long.
    (rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy(BUCKET).parquet(path))
