"""Upserts and deletes on tables keyed by id, as batch jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Last write per key.

    The rank filter lets each task keep one row per key before the shuffle, so
    a key with very many versions costs one row per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str | None = None
) -> DataFrame:
    """Merge rows by key, the incoming side replacing all properties.

    Several incoming rows for a key: the highest ``seq`` wins, then (or without one) the row whose
    values hash highest, so that reruns keep the same row.
    """
    marked = existing.withColumn("__new", F.lit(0)).unionByName(
        incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    hashed = [name for name, kind in marked.dtypes if "map<" not in kind and kind != "variant"]
    order = [F.desc("__new")] + ([F.desc_nulls_last(seq)] if seq else []) + [
        F.desc(F.xxhash64(*hashed))]
    return latest_by(marked, keys, *order).drop("__new")


def upsert_children(
    existing: DataFrame, incoming: DataFrame, parents: DataFrame, parent_key: str, seq: str
) -> DataFrame:
    """Upsert nodes whose parent exists; others are silently left out."""
    ids = parents.select(F.col("id").alias(parent_key))
    return upsert(existing, incoming.join(ids, parent_key, "left_semi"), ["id"], seq)


def upsert_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add edges whose both ends exist; the merge key includes rel and type."""
    ids = nodes.select("id")
    valid = incoming.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    columns = ["src", "dst", "rel", "type"]
    return existing.select(*columns).unionByName(valid.select(*columns)).distinct()


def replace_by(existing: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Drop all rows of changed keys and add the re-extracted ones.

    Rows that vanished from a changed key are removed, not kept.
    """
    return existing.join(changed.select(key).distinct(), key, "left_anti").unionByName(
        fresh.join(changed.select(key).distinct(), key, "left_semi"), allowMissingColumns=True
    )


def retain(df: DataFrame, ts: str, as_of: Column, max_age_days: int = 30) -> DataFrame:
    """Rows not older than a number of days."""
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(max_age_days)} DAYS"))


def retention_counts(
    df: DataFrame, ts: str, as_of: Column, max_age_days: int = 30
) -> DataFrame:
    """Rows a retention run would delete and keep."""
    kept = F.col(ts) >= as_of - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
    return df.agg(
        F.count_if(~kept).alias("deleted_count"), F.count_if(kept).alias("kept_count")
    )
