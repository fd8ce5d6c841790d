"""The inverted index next to brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from codeshoal.operators import search as SE
from codeshoal.operators import text_index as TI


def vector(text, buckets):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets for w in words)


def brute(texts, queries, k, buckets):
    found = []
    for q, asked in queries:
        a = vector(asked, buckets)
        scored = []
        for i, text in texts:
            b = vector(text, buckets)
            dot = sum(n * b[t] for t, n in a.items())
            if dot:
                norm = (float(sum(n * n for n in a.values())) * float(sum(n * n for n in b.values())))
                scored.append((-dot / norm ** 0.5, i))
        found += [(q, i, r + 1, round(-s, 12)) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def run(spark, texts, queries, k, buckets):
    index = TI.build_index(
        spark.createDataFrame(texts, "id long, text string"), buckets=buckets)
    rows = TI.search(index, spark.createDataFrame(queries, "query_id long, text string"), k, buckets)
    return sorted((r.query_id, r.id, r["rank"], round(r.score, 12)) for r in rows.collect())


def test_search_matches_brute_force(spark):
    rng = random.Random(1)
    # A few very common words, and rare ones with a long tail.
    words = ["the"] * 60 + ["of"] * 30 + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    texts += [(400, None), (401, ""), (402, "12 34 ½"), (403, "The THE the"), (404, "The THE the"),
              (405, "Öl öl straße"), (406, "of " * 5000)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 15)))) for i in range(25)]
    queries += [(50, "the"), (51, None), (52, "unknown zzz"), (53, "ÖL"), (54, "the of"), (55, "7")]
    for k, buckets in ((3, 1 << 20), (10, 64)):
        assert run(spark, texts, queries, k, buckets) == brute(texts, queries, k, buckets)


def test_empty_index_and_no_queries(spark):
    assert run(spark, [], [(1, "a")], 3, 64) == []
    assert run(spark, [(1, "a")], [], 3, 64) == []


def test_semantic_hits_are_nearest_sources(spark):
    snippets = spark.createDataFrame(
        [("a", "load", "def load(): open file", "x.py", "python"),
         ("b", "send", "def send(): socket write", "y.py", "python"), ("c", "none", None, "z.py", None)],
        "id string, function_name string, content string, path string, language string")
    hits = SE.semantic_hits(snippets, "open the file", 5).collect()
    assert [(h.id, h.type, h.name) for h in hits] == [("a", "Snippet", "load")]


def test_postings_count_a_text_once(spark):
    texts = spark.createDataFrame([(1, "a b a")], "id long, text string")
    counted = TI.postings(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("zip_with(") == 1
