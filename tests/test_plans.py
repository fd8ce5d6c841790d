"""Plan shapes that decide how the jobs behave on large inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeshoal.operators import corpus as CO
from codeshoal.operators import findings as FN
from codeshoal.operators import graph as G
from codeshoal.operators import rules as R
from codeshoal.operators import structure as S
from codeshoal.operators import taint as T
from codeshoal.operators import upserts as U
from codeshoal.plans import analysis as A
from codeshoal.registry.base import code_files
from codeshoal.sources import files as SRC


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "files")
    spark.range(200).select(
        F.col("id").alias("file_id"), F.lit("r").alias("repo_id"),
        F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"),
        F.lit("eval(x)\n").alias("content"), F.lit("unused").alias("zzz"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("scan", [
    R.security_scan, R.performance_scan, S.functions, S.classes, S.imports, T.taint_flows,
    T.taint_sources, A.analyze, S.extract,
])
def test_file_passes_are_narrow(files, scan):
    """No shuffle, no Python, no nested loop; unused columns are not read."""
    text = plan(scan(files))
    for node in ("Exchange", "Python", "NestedLoop", "Cartesian", "Sort "):
        assert node not in text
    assert "zzz" not in text


def test_cut_listings_are_top_k(files):
    assert "TakeOrderedAndProject" in plan(FN.first_findings(R.security_scan(files)))
    text = plan(FN.page(R.security_scan(files), [F.col("path"), F.col("line_start")]))
    assert "TakeOrderedAndProject" in text and "Window" not in text


def test_ranks_are_limited_before_the_shuffle(files):
    assert "WindowGroupLimit" in plan(U.latest_by(files, ["repo_id"], F.desc("file_id")))
    assert "WindowGroupLimit" in plan(SRC.cap_files(files, max_bytes=10_000, max_files=100))


def test_reachability_grows_linearly(spark):
    edges = spark.createDataFrame([(1, 2, "d")], "src int, dst int, type string")
    roots = spark.createDataFrame([(1,)], "id int")
    sizes = [plan(G.reachable(edges, roots, d)).count("Join") for d in (2, 4, 8)]
    assert sizes == [2, 4, 8]


def test_weighting_needs_no_global_limit(spark):
    text = plan(CO.take_fraction(spark.range(1000).withColumnRenamed("id", "k"), "k", 0.5))
    assert "GlobalLimit" not in text and "CollectLimit" not in text and "Cartesian" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_call_edges_parse_each_file_once(make_files):
    files = make_files({"a.py": "def f():\n    g()\n", "b.py": "def g():\n    f()\n"})
    edges = S.call_edges(files)
    # What is joined comes from files; no branch masks a text again.
    assert "regexp" not in edges._jdf.queryExecution().toString()
    assert edges.count() == 2


def test_masked_once_for_entries_and_calls(make_files):
    files = make_files({"a.py": "def f():\n    g()\n"})
    parsed = S.extract(files)._jdf.queryExecution().optimizedPlan().toString()
    # Each language's text is masked in one place.
    assert parsed.count(r"(?d)\\.") == len(S.BRACE_LANGUAGES) + 1


def test_files_dealt_by_key_are_joined_where_they_are(spark, tmp_path):
    """Texts move once, to be dealt out; a large table of labels comes to them."""
    rows = spark.createDataFrame([(1, "a", "s"), (None, "b", "s")],
                                 "doc_id bigint, text string, source string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        labels = spark.createDataFrame([(1, 0), (1, 1)], "file_id bigint, toxic int")
        labels = labels.groupBy("file_id").agg(F.max("toxic").alias("toxic"))
        joined = code_files(spark, str(tmp_path), by_key=True).join(labels, "file_id", "left")
        text = plan(joined)
        assert text.count("Exchange ") == 2 and "SortMergeJoin" in text
        assert {(r.file_id, r.toxic) for r in joined.collect()} == {(1, 1), (None, None)}
    finally:
        spark.conf.unset(threshold)
