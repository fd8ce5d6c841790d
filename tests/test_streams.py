"""Streams over several files, so state crosses micro-batches."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_tables import brute_force

from codeshoal.operators.jobs import latest_status
from codeshoal.streaming import pipelines as P
from codeshoal.streaming import state as ST
from codeshoal.streaming import windows as SW

START = datetime(2024, 1, 1)


def in_batches(spark, folder, rows, schema, parts):
    """Rows as files read one per micro-batch, in order of time."""
    size = -(-len(rows) // parts)
    seen = set()
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode(
            "append").parquet(str(folder))
        # Streams take files in order of modification time.
        for path in set(folder.glob("*.parquet")) - seen:
            seen.add(path)
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("accepted_only", [True, False])
def test_rate_limit_across_batches(spark, tmp_path, accepted_only):
    rng = random.Random(11)
    rows = sorted(
        ((i, f"c{rng.randrange(3)}", START + timedelta(seconds=rng.uniform(0, 600))) for i in range(150)),
        key=lambda r: r[2])
    stream = in_batches(
        spark, tmp_path / "in", rows, "event_id bigint, client string, ts timestamp", 3)
    out = P.run_available(
        ST.limit_stream(stream, 3, 60, accepted_only, delay="1 minute"), str(tmp_path / "out"))
    got = {r["event_id"]: r["allowed"] for r in out.collect()}
    assert got == brute_force(rows, 3, 60, accepted_only)


def test_status_changes_end_at_latest_status(spark, tmp_path):
    rng = random.Random(2)
    states = ["queued", "running", "completed", "failed"]
    rows = [(i, rng.randrange(4), START + timedelta(seconds=i), rng.choice(states)) for i in range(80)]
    schema = "event_id bigint, job_id int, ts timestamp, status string"
    stream = in_batches(spark, tmp_path / "in", rows, schema, 2)
    out = P.run_available(ST.status_changes(stream), str(tmp_path / "out"))
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["us"]):
        assert last.get(r["job_id"]) != r["status"]
        last[r["job_id"]] = r["status"]
    batch = latest_status(spark.createDataFrame(rows, schema))
    assert last == {r["job_id"]: r["status"] for r in batch.collect()}


def test_windows_drop_late_rows(spark, tmp_path):
    """Lateness is judged by the watermark the previous batch ran with."""
    rows = [(1, "t", "success", START), (2, "t", "success", START + timedelta(hours=5)),
            (5, "t", "success", START + timedelta(hours=6)),
            (3, "t", "success", START + timedelta(minutes=1)),
            (4, "t", "success", START + timedelta(hours=9))]
    schema = "event_id bigint, task_type string, status string, ts timestamp"
    stream = in_batches(spark, tmp_path / "in", rows, schema, 5)
    out = P.run_available(SW.task_counts(stream), str(tmp_path / "out"))
    got = sorted((r["window_start"], r["n"]) for r in out.collect())
    assert got == [(START + timedelta(hours=h), 1) for h in (0, 5, 6)]


def test_index_log_replaces_changed_files(spark, tmp_path):
    schema = "file_id bigint, name string"
    stream = in_batches(
        spark, tmp_path / "in", [(1, "old"), (1, "gone"), (2, "kept"), (1, "new")], schema, 2)
    # Two rows per file: the second batch holds file 2's row and file 1's new one.
    P.append_changes(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    now = P.current_rows(spark.read.parquet(str(tmp_path / "log")))
    assert sorted((r["file_id"], r["name"]) for r in now.collect()) == [(1, "new"), (2, "kept")]


def test_index_log_forgets_rows_of_an_emptied_file(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for texts in ({"a": "x y", "b": "z"}, {"a": ""}):
        spark.createDataFrame(list(texts.items()), "file_id string, text string").coalesce(
            1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("file_id string, text string").parquet(source)
        P.append_changes(
            stream, log, str(tmp_path / "cp"),
            lambda batch: batch.select("file_id", F.explode(F.split("text", " ")).alias("word"))
            .where("word <> ''"),
        ).awaitTermination()
    now = P.current_rows(spark.read.parquet(log), touched=P.touched_keys(spark, log))
    assert [tuple(r) for r in now.collect()] == [("b", "z")]


def test_table_streams_read_files_and_folders(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(20)]
    table = spark.createDataFrame(rows, "id bigint, text string")
    table.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "one.parquet")
    for name in ("many", "one"):
        stream = P.read_table_stream(spark, str(tmp_path), name)
        out = P.run_available(stream, str(tmp_path / f"out-{name}"))
        assert sorted(map(tuple, out.collect())) == rows
