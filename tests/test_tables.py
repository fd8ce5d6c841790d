"""Requests, graph, corpus, vectors and inference against brute force."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeshoal.operators import corpus as CO
from codeshoal.operators import findings as FN
from codeshoal.operators import graph as G
from codeshoal.operators import inference as I
from codeshoal.operators import jobs as J
from codeshoal.operators import requests as RQ
from codeshoal.operators import search as SE
from codeshoal.operators import upserts as U
from codeshoal.operators import vectors as V

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests(spark):
    """One client sends a third of all requests, in bursts."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        client = "hot" if i % 3 == 0 else f"c{rng.randrange(20)}"
        seconds = rng.choice([rng.uniform(0, 40), rng.uniform(0, 2000)])
        rows.append((i, client, START + timedelta(microseconds=int(seconds * 1e6))))
    return rows


def brute_force(rows, limit, window, accepted_only):
    verdict, seen = {}, {}
    for i, client, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        past = seen.setdefault(client, [])
        recent = [t for t in past if (ts - t).total_seconds() < window and
                  (accepted_only or t < ts)]
        verdict[i] = len(recent) < limit
        if verdict[i] or not accepted_only:
            past.append(ts)
    return verdict


@pytest.mark.parametrize("limit,window", [(3, 60), (1, 5), (20, 300)])
def test_rate_limits(spark, requests, limit, window):
    df = spark.createDataFrame(requests, "request_id bigint, client string, ts timestamp")
    shared = {r["request_id"]: r["allowed"]
              for r in RQ.sliding_rate_limit(df, limit, window).collect()}
    assert shared == brute_force(requests, limit, window, False)
    accepted = {r["request_id"]: r["allowed"]
                for r in RQ.accepted_rate_limit(df, limit, window).collect()}
    assert accepted == brute_force(requests, limit, window, True)


def test_a_hot_client_is_decided_in_many_pieces(spark):
    """Never a pause of a window, yet cut wherever a whole window stayed below the limit."""
    rng = random.Random(11)
    rows, at = [], 0.0
    for i in range(6000):
        at += rng.choice([0, 0.01, 0.5]) if i % 300 < 100 else rng.uniform(0.5, 4)
        rows.append((i, "hot" if i % 50 else None, START + timedelta(microseconds=int(at * 1e6))))
    df = spark.createDataFrame(rows, "request_id bigint, client string, ts timestamp")
    got = {r["request_id"]: r["allowed"]
           for r in RQ.accepted_rate_limit(df, 30, 20).collect()}
    expected = brute_force(rows, 30, 20, True)
    assert got == expected and 500 < sum(not ok for ok in expected.values()) < 5000
    pieces = RQ._pieces(df, 30, 20_000_000).filter("client = 'hot'").groupBy("piece").agg(
        F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("before")).collect()
    assert len(pieces) > 100 and max(p["own"] for p in pieces) < 400
    assert max(p["before"] for p in pieces) <= 30
    # Always above the limit: a single piece, with the same rows.
    busy = [(i, "x", START + timedelta(milliseconds=100 * i)) for i in range(2000)]
    df = spark.createDataFrame(busy, "request_id bigint, client string, ts timestamp")
    got = {r["request_id"]: r["allowed"] for r in RQ.accepted_rate_limit(df, 5, 10).collect()}
    assert got == brute_force(busy, 5, 10, True)


def test_page_and_total_come_from_one_pass(spark):
    df = spark.range(1000).withColumn("seen", F.col("id") % 7)
    order = [F.desc("seen"), F.asc("id")]
    for number in (1, 3, 50, 51):
        once = FN.page_at_once(df, order, number, 20)
        assert [tuple(r) for r in once.collect()] == [
            tuple(r) for r in FN.page(df, order, number, 20).collect()]
    assert FN.page_at_once(df, order, 2, 5).dtypes == FN.page(df, order, 2, 5).dtypes
    assert FN.page_at_once(df.filter("id < 0"), order).count() == 0
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    FN.page_at_once(spark.range(500).mapInPandas(counted, "id long"), [F.asc("id")]).collect()
    assert passes.value == 500


def test_latency_quantile_with_ties(spark):
    rng = random.Random(3)
    values = {
        "ties": [1.0] * 4000 + [rng.random() for _ in range(3000)],
        "wide": [rng.expovariate(1) for _ in range(9000)], "one": [5.0], "two": [2.0, 1.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    for q in (0.95, 0.5, 0.999):
        got = {r["k"]: r["quantile_value"]
               for r in RQ.latency_stats(df, "k", "v", q).collect()}
        assert got == {k: sorted(v)[int(len(v) * q)] for k, v in values.items()}


@pytest.mark.parametrize("kind", ["long", "double"])
def test_latency_quantile_of_a_hot_key(spark, kind):
    """Each cut of the sketch may also be a value that many rows have."""
    df = spark.range(120_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"),
        F.when(F.col("id") % 5 == 0, F.col("id") % 50).otherwise(
            F.pmod(F.xxhash64("id"), F.lit(10**12))).cast(kind).alias("v"))
    rows: dict = {}
    for r in df.collect():
        rows.setdefault(r["k"], []).append(r["v"])
    for q in (0.0, 0.1, 0.95, 0.9999):
        got = {r["k"]: r["quantile_value"] for r in RQ.latency_stats(df, "k", "v", q).collect()}
        assert got == {k: sorted(v)[int(len(v) * q)] for k, v in rows.items()}


def test_latency_quantile_ranks_a_short_slice(spark, monkeypatch):
    """The window sees the values between two cuts, not a band of the group."""
    seen = spark.sparkContext.accumulator(0)
    ranked = F.udf(lambda v: (seen.add(1), v)[1], "double").asNondeterministic()
    df = spark.range(200_000, numPartitions=4).select(
        F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("v"))
    partition = RQ.W.partitionBy
    monkeypatch.setattr(RQ.W, "partitionBy", lambda key: partition(ranked(F.lit(0.0)), key))
    value = RQ.latency_stats(df, "k", "v").first()["quantile_value"]
    assert value == sorted(r["v"] for r in df.collect())[190_000]
    assert 0 < seen.value <= 40


def test_error_rate_of_nothing(spark):
    empty = spark.createDataFrame([], "status string")
    row = RQ.error_rate(empty, F.col("status") == "failure").first()
    assert (row["request_count"], row["error_rate"]) == (0, 0.0)


def test_backlog_carries_over_days(spark):
    flow = spark.createDataFrame(
        [(START + timedelta(hours=8 * i), n) for i, n in enumerate([5, -2, 4, -1, 7])],
        "window_start timestamp, net bigint")
    got = [r["backlog"] for r in RQ.backlog(flow, 6).orderBy("window_start").collect()]
    assert got == [5, 3, 7, 6, 13]


def test_reachability_with_cycles(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)} | {(0, i) for i in range(12)}
    df = spark.createDataFrame([(a, b, "direct") for a, b in edges], "src int, dst int, type string")
    hops, front = {0: 0}, {0}
    for level in range(1, 5):
        front = {b for a, b in edges if a in front} - set(hops)
        hops.update({n: level for n in front})
        roots = spark.createDataFrame([(0,)], "id int")
        got = {r["id"]: r["hop"] for r in G.reachable(df, roots, level).collect()}
        assert got == hops
    used = {(r["src"], r["dst"]) for r in G.reachable_edges(df, roots, 4).collect()}
    assert used == {(a, b) for a, b in edges if hops.get(a, 9) < 4}
    with pytest.raises(ValueError):
        G.reachable(df, roots, 11)


def test_first_paths_are_exact(spark):
    rng = random.Random(9)
    edges = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(24)})
    df = spark.createDataFrame(edges, "src int, dst int")
    paths, layer = [], [[0]]
    for _ in range(4):
        layer = [p + [b] for p in layer for a, b in edges
                 if a == p[-1] and (a, b) not in set(zip(p, p[1:]))]
        paths += layer
    for limit in (1, 7, 40):
        got = [list(r["path"]) for r in G.first_paths(df, 0, 4, limit).collect()]
        assert sorted(got) == sorted(paths)[:limit]


def test_upserts_are_idempotent(spark):
    nodes = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "id string, name string, seq int")
    fresh = spark.createDataFrame([("b", "z", 2), ("b", "w", 3), ("c", "v", 1)],
                                  "id string, name string, seq int")
    once = U.upsert(nodes, fresh, ["id"], "seq")
    assert {r["id"]: r["name"] for r in once.collect()} == {"a": "x", "b": "w", "c": "v"}
    assert U.upsert(once, fresh, ["id"], "seq").exceptAll(once).count() == 0
    edges = spark.createDataFrame([], "src string, dst string, rel string, type string")
    new = spark.createDataFrame([("a", "b", "CALLS", "direct"), ("a", "b", "CALLS", "direct"),
                                 ("a", "zz", "CALLS", "direct")], edges.schema)
    assert U.upsert_edges(edges, new, nodes).count() == 1


def test_index_and_cascade_delete(spark, make_files, tmp_path):
    files = make_files({"a.py": "def f():\n    g()\n\ndef g(): pass\nclass K:\n    pass\n",
                        "b.rb": "x"}, repo="one").unionByName(
        make_files({"c.py": "def h():\n    pass\n"}, repo="two"))
    nodes, edges, snippets = G.index_repository(files, str(tmp_path / "index"))
    assert {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()} == {
        "Repository": 2, "File": 3, "Function": 3, "Class": 1}
    texts = {r["function_name"]: r["content"] for r in snippets.collect()}
    assert texts == {"f": "def f():\n    g()", "g": "def g(): pass", "h": "def h():\n    pass"}
    f_id = hashlib.md5(b"one:a.py:f").hexdigest()
    row = G.function_detail(nodes, edges, f_id).first()
    assert row["calls"] == [hashlib.md5(b"one:a.py:g").hexdigest()]
    assert (row["called_by"], row["file_path"], row["language"]) == ([], "a.py", "python")
    kept, kept_edges = G.delete_repository(nodes, edges, "one")
    assert {r["repo_id"] for r in kept.collect()} == {"two"}
    assert kept_edges.count() == 2
    hits = SE.hybrid_search(nodes, "a.py", None, "graph", 5)
    assert [r["score"] for r in hits.collect()] == [0.5]


@pytest.mark.parametrize("n,weight", [(1000, 0.4), (17, 0.3), (10, 0.0), (10, 1.5), (5000, 0.999)])
def test_take_fraction_is_exact(spark, n, weight):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r["k"] for r in CO.take_fraction(df, "k", weight).collect()}
    order = sorted(range(n), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert got == set(order[: int(n * weight)])


def test_mix_is_stable_under_partitioning(spark):
    a = spark.range(300).withColumnRenamed("id", "k")
    b = spark.range(1000, 1200).withColumnRenamed("id", "k")
    first = [r["k"] for r in CO.weighted_mix([(a, 0.5), (b, 1.0)], "k").collect()]
    again = [r["k"] for r in
             CO.weighted_mix([(a.repartition(7), 0.5), (b.repartition(3), 1.0)], "k").collect()]
    assert first == again and len(first) == 350
    single = CO.weighted_mix([(a, 1.0)], "k")
    assert [r["k"] for r in single.collect()] == list(range(300))


def test_pairs_come_from_extremes(spark):
    df = spark.createDataFrame(
        [("p", "a", 1), ("p", "b", 3), ("p", "c", 2), ("q", "d", 1), ("q", "e", 1)],
        "prompt string, response string, score int")
    pairs = CO.to_pairwise(df, "prompt", "response", "score")
    assert [(r["prompt"], r["chosen"], r["rejected"]) for r in pairs.collect()] == [("p", "b", "a")]
    assert CO.to_pointwise(pairs, "prompt").count() == 2


def test_length_groups_keep_rows_and_split_hot_lengths(spark):
    df = spark.range(4000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), F.lit(10)))
        .otherwise(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("t"))
    grouped = CO.group_by_length(df, "t", "k", 8)
    sizes = [r["count"] for r in grouped.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 3


def test_nearest_agrees_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    m[10] = m[11]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                               "id int, embedding array<float>").repartition(5)
    queries = df.filter("id < 7").withColumnRenamed("id", "query_id")
    f = np.asarray(m, dtype=np.float32).astype(np.float64)
    unit = f / np.linalg.norm(f, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, V.DIGITS)
    want = sorted(
        (q, i, rank) for q in range(7)
        for rank, i in enumerate(sorted(range(60), key=lambda i: (-scores[q, i], i))[:4], 1))
    for block in (V.QUERY_BLOCK, 3):  # three rows a block: many pairs of blocks
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        monkeypatch.setattr(V, "VECTOR_BLOCK", 4 * block)
        got = V.nearest(queries, df, 4).select("query_id", "id", "rank").collect()
        assert sorted(tuple(r) for r in got) == want


def test_hashing_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b a a")], "id int, text string")
    one, two = [r["embedding"] for r in V.hashing_embeddings(df).orderBy("id").collect()]
    assert len(one) == 384 and one == two
    assert abs(sum(x * x for x in one) - 1) < 1e-6


def test_generation_isolates_failures(spark):
    def load(name):
        if name == "gone":
            raise RuntimeError("gone")
        return lambda texts: [str(10 // int(t)) for t in texts]

    df = spark.createDataFrame([(1, "5", None), (2, "0", "gone"), (3, "2", "gone"), (4, "1", "big")],
                               "id int, prompt string, model string").coalesce(1)
    got = {r["id"]: (r["text"], r["model_used"], r["error"] is None)
           for r in I.generate(df, load).collect()}
    assert got == {1: ("2", "default", True), 2: (None, "default", False),
                   3: ("5", "default", True), 4: ("10", "big", True)}


def test_analyzer_errors_become_rows(spark):
    def analyze(code, language):
        if code == "bad":
            raise ValueError("nope")
        return [{"finding_type": "quality", "rule_id": "R", "line_start": 1}]

    df = spark.createDataFrame([(1, "ok", "python"), (2, "bad", "python")],
                               "id int, code string, language string")
    got = {r["id"]: (r["finding_type"], r["message"]) for r in I.run_analyzer(df, analyze).collect()}
    assert got == {1: ("quality", None), 2: ("error", "nope")}


def test_jobs(spark):
    df = spark.createDataFrame(
        [(1, 5, START, "queued"), (2, 1, START + timedelta(1), "queued"), (3, 5, START - timedelta(1), "x")],
        "id int, priority int, created_at timestamp, status string")
    assert [r["id"] for r in J.by_priority(df).collect()] == [2, 3, 1]
    asked = spark.createDataFrame([(1,), (9,)], "id int")
    assert {r["id"]: r["found"] for r in J.lookup(df, asked).collect()} == {1: True, 9: False}


def test_nearest_of_odd_vectors(spark):
    stored = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])],
        "id long, embedding array<double>")
    asked = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [3.0]), ("c", None), ("d", [1.0, 0.0, 0.0])],
        "query_id string, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in V.nearest(asked, stored, 2).collect())
    assert got == [("a", 1, 1, 1.0), ("a", 2, 6, 1.0), ("b", 1, 4, 1.0)]
    assert V.nearest(asked.limit(0), stored).count() == 0
    assert V.nearest(asked, stored.limit(0)).count() == 0
