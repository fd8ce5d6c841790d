"""Bucketed stores: the rows of a plain upsert, and only touched buckets read or written."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from codeshoal.operators import upserts as U
from codeshoal.registry.stream_queries import j3_buckets
from codeshoal.sources import stores as ST
from codeshoal.streaming import pipelines as P

SCHEMA = "id bigint, name string, seq int"


def files_of(path):
    return {os.path.join(folder, name) for folder, _, names in os.walk(path)
            for name in names if name.endswith(".parquet")}


def bucket(file):
    return int(os.path.basename(os.path.dirname(file)).split("=")[1])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_three_batches_equal_plain_upserts(spark, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "store")
    plain = spark.createDataFrame([(i, f"n{i}", 0) for i in range(300)] + [(None, "none", 0)], SCHEMA)
    ST.write_store(plain, path, ["id"], 8)
    assert rows_of(ST.read_store(spark, path)) == rows_of(plain)
    for step in range(1, 4):
        batch = [(rng.choice([None, rng.randrange(400)]), f"s{step}-{k}", k) for k in range(60)]
        incoming = spark.createDataFrame(batch, SCHEMA)
        plain = spark.createDataFrame(U.upsert(plain, incoming, ["id"], "seq").collect(), SCHEMA)
        ST.upsert_store(spark, path, incoming, ["id"], "seq", 8)
        assert rows_of(ST.read_store(spark, path)) == rows_of(plain)
        # A batch that is given again changes nothing.
        ST.upsert_store(spark, path, incoming, ["id"], "seq", 8)
        assert rows_of(ST.read_store(spark, path)) == rows_of(plain)


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    ST.write_store(spark.range(1000).selectExpr("id", "'old' name", "0 seq"), path, ["id"], 16)
    before = files_of(path)
    touched = ST.upsert_store(
        spark, path, spark.createDataFrame([(7, "new", 1)], SCHEMA), ["id"], "seq", 16)
    assert len(touched) == 1
    changed = before ^ files_of(path)
    assert {bucket(f) for f in changed} == set(touched)
    plan = ST.read_buckets(spark, path, touched)
    assert {bucket(f) for f in plan.inputFiles()} >= set(touched)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [(bucket" in text
    assert ST.read_store(spark, path).where("name = 'new'").count() == 1


def test_stored_types_stay(spark, tmp_path):
    """A batch of narrower types, other column order and more columns takes the store's form."""
    path = str(tmp_path / "store")
    ST.write_store(spark.createDataFrame([(1, "a", 1)], SCHEMA), path, ["id"], 4)
    batch = spark.range(1, 3).selectExpr("'x' extra", "cast(5 as smallint) seq", "'b' name", "id")
    ST.upsert_store(spark, path, batch, ["id"], "seq", 4)
    assert ST.read_store(spark, path).schema.simpleString() == \
        "struct<id:bigint,name:string,seq:int>"
    assert rows_of(ST.read_store(spark, path)) == [(1, "b", 5), (2, "b", 5)]


@pytest.mark.parametrize("start", [[], [("a", "x"), ("a", "y"), ("b", "z")]])
def test_stream_of_batches_that_empty_a_file(spark, tmp_path, start):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    ST.write_store(
        spark.createDataFrame(start, "file_id string, word string"), path, ["file_id"], 4)
    for texts in ({"a": "x y", "b": "z"}, {"b": "z z2", "c": ""}, {"a": "", "b": ""}, {}):
        batch = spark.createDataFrame(list(texts.items()), "file_id string, text string")
        batch.coalesce(1).write.mode("append").parquet(source)
        P.store_changes(
            spark.readStream.schema(batch.schema).parquet(source), path, str(tmp_path / "cp"),
            lambda b: b.select("file_id", F.explode(F.split("text", " ")).alias("word"))
            .where("word <> ''"), buckets=4,
        ).awaitTermination()
        if texts.get("b") == "z z2":
            assert rows_of(ST.read_store(spark, path)) == [
                ("a", "x"), ("a", "y"), ("b", "z"), ("b", "z2")]
    assert rows_of(ST.read_store(spark, path)) == []


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    """AQE cuts a long bucket, which a key with most rows makes."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("file_id"),
            F.hex(F.xxhash64("id")).alias("name"))
        path = str(tmp_path / "store")
        ST.write_store(rows, path, ["file_id"], 4)
    finally:
        spark.conf.unset(size)
    assert ST.read_store(spark, path).count() == 200_000
    hot = rows.where("file_id = -1").limit(1).select(ST.bucket_of(["file_id"], 4)).first()[0]
    assert sum(bucket(f) == hot for f in files_of(path)) > 2


def test_later_batches_read_the_files_that_arrived(spark, tmp_path, monkeypatch):
    """Files are made from the documents once: what becomes of the table later changes nothing."""
    documents, labels = str(tmp_path / "documents.parquet"), str(tmp_path / "labels.parquet")
    rows = spark.createDataFrame(
        [(14, "a"), (14, "a"), (1, "b\nc"), (2, "d"), (9, "e"), (None, "f")],
        "doc_id bigint, text string").withColumn("source", F.lit("s"))
    rows.coalesce(1).write.parquet(documents)
    spark.createDataFrame([(1, 0), (1, 0), (2, 1), (9, 1), (None, 1), (99, 1)],
                          "doc_id bigint, toxic int").coalesce(1).write.parquet(labels)
    store = P.store_changes

    def change(*args, **kwargs):
        rows.where("false").coalesce(1).write.mode("overwrite").parquet(documents)
        return store(*args, **kwargs)

    monkeypatch.setattr(P, "store_changes", change)
    got = rows_of(j3_buckets(spark, str(tmp_path)))
    # Each copy of a file meets both copies' versions.
    assert got == [(1, "load1_v2", 1)] + [(14, "q14_v1", 2)] * 4
