"""Running streams to completion, and log-structured index maintenance."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogs import PERFORMANCE_RULES, SECURITY_RULES
from ..operators.rules import scan
from ..session import DEFAULTS, scratch_dir
from ..sources.stores import BUCKETS, replace_store

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder as a stream, with its own schema; one file, or a folder of them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(os.path.join(folder, f"{name}.parquet")).schema
    # A stream takes a plain path for a folder; a pattern, which may find a file as well, it lists.
    return spark.readStream.schema(schema).parquet(os.path.join(folder, f"{name}.parque[t]"))


def run_available(stream: DataFrame, out: str) -> DataFrame:
    """Process what is there now into parquet and return it as a table."""
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    data = os.path.join(out, "data")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", os.path.join(out, "checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(data)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(data)


def scan_stream(files: DataFrame) -> DataFrame:
    """Findings of new files: stateless, each file scanned once."""
    return scan(files, SECURITY_RULES + PERFORMANCE_RULES)


def append_changes(stream: DataFrame, path: str, checkpoint: str, derive: Callable | None = None,
                   key: str = "file_id"):
    """Keep an index as a log: every micro-batch is one partition of it.

    ``derive`` makes the rows of a batch (none: the batch itself).  The keys of the batch are
    logged beside them, so that a key that has no rows any more loses its older ones; they
    are written last, so a reader never finds a batch's keys without its rows.
    Writing a batch replaces its own partition, so a retried batch does not
    duplicate rows; readers use current_rows with touched_keys.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = derive(batch) if derive else batch
        rows.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
        batch.select(key).distinct().write.mode("overwrite").parquet(
            os.path.join(_keys_path(path), f"batch={batch_id}"))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _keys_path(path: str) -> str:
    return path.rstrip("/") + "-keys"


def touched_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, batch): the keys of each micro-batch that append_changes logged at ``path``."""
    return spark.read.parquet(_keys_path(path))


def store_changes(stream: DataFrame, path: str, checkpoint: str, derive: Callable | None = None,
                  key: str = "file_id", buckets: int = BUCKETS):
    """Keep a bucketed store (``write_store``, with the same key and buckets) up to date.

    Every micro-batch gives its keys the rows that ``derive`` makes of it (none: the batch
    itself) and rewrites the buckets of these keys only; a key without rows loses what it had.
    Repeating a batch leaves the same store, so one that was lost half way is safe.  The batch
    is read and derived once.  A key that comes several times in a batch keeps all its rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        beside = scratch_dir(spark, f"batch-{batch_id}")
        batch.write.parquet(f"{beside}/batch")
        arrived = spark.read.schema(batch.schema).parquet(f"{beside}/batch")
        rows = derive(arrived) if derive else arrived
        if derive:
            rows.write.parquet(f"{beside}/rows")
            rows = spark.read.schema(rows.schema).parquet(f"{beside}/rows")
        replace_store(spark, path, rows, arrived.select(key), key, buckets)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rows(log: DataFrame, key: str = "file_id", touched: DataFrame | None = None
                 ) -> DataFrame:
    """Rows of the last batch that touched each key: older ones are gone.

    Without ``touched`` a key counts as touched only by batches in which it has rows.
    """
    last = (log if touched is None else touched).groupBy(key).agg(F.max("batch").alias("batch"))
    return log.join(last, [key, "batch"], "left_semi").drop("batch")
