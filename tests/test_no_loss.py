"""Rows that must not be lost: odd inputs, late rows, null keys and faulty models."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeshoal.catalogs import LineRule
from codeshoal.operators import inference as I
from codeshoal.operators import requests as RQ
from codeshoal.operators import rules as R
from codeshoal.operators import vectors as V
from codeshoal.streaming.state import RateLimiter


def test_whole_texts_are_encoded(spark):
    df = spark.createDataFrame([(1, "a" * 9_000)], "id int, text string")
    sizes = I.embed(df, lambda: lambda texts: [[float(len(t))] for t in texts])
    assert sizes.first()["embedding"] == [9_000.0]
    one, two = [r["embedding"] for r in V.hashing_embeddings(spark.createDataFrame(
        [(1, "a b " * 2_000), (2, "a b " * 2_000 + "c")], "id int, text string"
    )).orderBy("id").collect()]
    assert one != two


def test_a_model_with_too_few_answers_gives_errors(spark):
    df = spark.createDataFrame([(i, f"p{i}", None) for i in range(3)],
                               "id int, prompt string, model string")
    rows = I.generate(df.coalesce(1), lambda name: lambda texts: texts[:1]).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2]
    rows = I.generate(df.coalesce(1), lambda name: lambda texts: []).collect()
    assert len(rows) == 3 and all(r["error"] for r in rows)


def test_latency_of_null_keys_and_null_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0), ("b", None)],
                               "k string, v double")
    got = {r["k"]: (r["n"], r["quantile_value"]) for r in RQ.latency_stats(df, "k", "v").collect()}
    assert got == {"a": (2, 2.0), None: (2, 7.0), "b": (0, None)}


def test_null_and_short_vectors_take_no_part(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, [None, 1.0])],
        "id long, embedding array<double>")
    assert [r["id"] for r in V.find_similar(df, [1.0, 0.1]).collect()] == [1, 3]


def test_a_task_sends_k_rows_per_query(spark):
    import numpy as np

    rows = spark.range(0, 40_000, 1, 1).select("id", F.array(
        F.rand(1), F.rand(2)).alias("embedding"))
    assert V._scored(rows, [0], np.array([[1.0, 0.5]]), 10).count() == 10


def test_no_rule_and_many_rules(spark, make_files):
    files = make_files({"a.py": "key1 = 1\nkey300 = 2"})
    assert R.scan(files, []).count() == 0
    many = [LineRule(f"U{i}", f"n{i}", "low", "m", "r", ("python",), f"key{i} ", "", "high", None)
            for i in range(301)]
    assert sorted(r["rule_id"] for r in R.scan(files, many).collect()) == ["U1", "U300"]


class _State:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_late_requests_count(spark):
    limit = RateLimiter(2, 60_000_000, False, False)
    limit.recent = _State()

    def send(*seconds):
        frame = pd.DataFrame({"us": [s * 1_000_000 for s in seconds], "event_id": range(len(seconds))})
        return next(limit.handleInputRows(("c",), [frame], None))["allowed"].tolist()

    assert send(1, 10, 40) == [True, True, False]
    assert send(5, 7) == [True, False]


def test_scratch_needs_a_shared_folder(monkeypatch):
    from codeshoal.session import scratch_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")


def test_callables_get_texts_a_slice_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame(
        [(i if i else None, "x" * 100 * i, "m" if i % 2 else None) for i in range(40)],
        "id long, text string, language string").coalesce(1)
    monkeypatch.setattr(I, "SLICE", 2_000)
    # The functions travel with what they read; SLICE is a bound of the module there.
    parts = list(I._sliced(df.toArrow().to_batches(), "text"))
    assert sum(p.num_rows for p in parts) == 40
    assert all(p.num_rows == 1 or sum(len(t) for t in p["text"].to_pylist()) <= 2_000 for p in parts)
    whole = [t for p in parts for t in p["text"].to_pylist()]
    assert whole == ["x" * 100 * i for i in range(40)]


def test_long_texts_reach_callables_in_parts(spark):
    rows = [(2 ** 60 + i if i else None, "x" * 400_000) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    ids = {i for i, _ in rows}
    # Twelve texts of 0.4 MB are never given at once, and long keys stay exact.
    counted = I.embed(df, lambda: lambda texts: [[float(len(texts))] for _ in texts]).collect()
    assert {r["id"] for r in counted} == ids and max(r["embedding"][0] for r in counted) < 12
    scored = I.score(df.selectExpr("id", "text AS query", "'' AS response"),
                     lambda: lambda texts: [len(texts) for _ in texts], "id").collect()
    assert {r["id"] for r in scored} == ids and max(r["reward"] for r in scored) < 12
    found = I.run_analyzer(
        df.selectExpr("id", "text AS code", "'' AS language"),
        lambda code, language: [{"line_start": len(code), "message": None}]).collect()
    assert {(r["id"], r["line_start"], r["line_end"], r["message"]) for r in found} == {
        (i, 400_000, None, None) for i in ids}
    said = I.generate(
        df.selectExpr("id", "text AS prompt"), lambda name: lambda texts: [str(len(texts)) for _ in texts],
        max_batch_size=100).collect()
    assert {r["id"] for r in said} == ids and max(int(r["text"]) for r in said) < 12
