"""Registered queries: graph, index maintenance, search and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search as SE
from ..operators import structure as S
from ..operators import text_index as TI
from ..operators import upserts as U
from ..operators import vectors as V
from ..session import scratch_dir
from ..sources.stores import read_store, upsert_store, write_store
from .base import code_files, table, with_files
from .scan_queries import CALLS, FUNCTIONS

INDEX = r"""last_functions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, name
    ORDER BY start_line DESC, end_line DESC) AS rn FROM measured WHERE kind = 'function') WHERE rn = 1),
last_classes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, name
    ORDER BY start_line DESC, end_line DESC) AS rn FROM measured WHERE kind = 'class') WHERE rn = 1),
nodes AS (
  SELECT DISTINCT repo_id AS id, 'Repository' AS label, repo_id, repo_id AS name, NULL AS path,
    NULL AS language, 0 AS complexity, 0 AS lines FROM code_files
  UNION ALL SELECT md5(concat(repo_id, ':', path)), 'File', repo_id, NULL, path, language, 0,
    len(string_split(content, chr(10))) FROM code_files
  UNION ALL SELECT md5(concat(repo_id, ':', path, ':', name)), 'Function', repo_id, name, NULL,
    language, complexity, 0 FROM last_functions
  UNION ALL SELECT md5(concat(repo_id, ':', path, ':', name)), 'Class', repo_id, name, NULL,
    language, 0, 0 FROM last_classes),
edges AS (
  SELECT repo_id AS src, md5(concat(repo_id, ':', path)) AS dst, 'CONTAINS' AS rel, '' AS type
    FROM code_files
  UNION ALL SELECT md5(concat(repo_id, ':', path)), md5(concat(repo_id, ':', path, ':', name)),
    'DEFINES', '' FROM last_functions
  UNION ALL SELECT md5(concat(repo_id, ':', path)), md5(concat(repo_id, ':', path, ':', name)),
    'DEFINES', '' FROM last_classes
  UNION ALL SELECT src, dst, 'CALLS', type FROM calls)"""
INDEX_CTES = (*FUNCTIONS, CALLS, INDEX)


def _index(spark, sf):
    nodes, edges, _ = G.index_repository(code_files(spark, sf), scratch_dir(spark, "index"))
    return nodes, edges


def a18(spark, sf):
    store = scratch_dir(spark, "index")
    nodes, edges, snippets = G.index_repository(code_files(spark, sf), store)
    return G.index_counts(nodes, edges, snippets)


A18_SQL = with_files("""SELECT (SELECT count(*) FROM nodes) AS nodes_created,
  (SELECT count(*) FROM edges) AS relationships_created,
  (SELECT count(*) FROM last_functions) AS vectors_indexed""", *INDEX_CTES)


def e15(spark, sf):
    nodes, edges = _index(spark, sf)
    by_label = nodes.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return by_label.unionByName(
        edges.groupBy(F.col("rel").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    )


E15_SQL = with_files("""SELECT label AS kind, count(*) AS n FROM nodes GROUP BY 1
UNION ALL SELECT rel, count(*) FROM edges GROUP BY 1""", *INDEX_CTES)


def d12(spark, sf):
    return G.contained(*_index(spark, sf)).select(
        "repo_id", "path", F.coalesce("member_label", F.lit("-")).alias("label"),
        F.coalesce("member_name", F.lit("-")).alias("name"),
    )


D12_SQL = with_files("""
SELECT c.src AS repo_id, f.path, coalesce(m.label, '-') AS label, coalesce(m.name, '-') AS name
FROM edges c JOIN nodes f ON f.id = c.dst AND f.label = 'File'
  LEFT JOIN edges d ON d.src = f.id AND d.rel = 'DEFINES' LEFT JOIN nodes m ON m.id = d.dst
WHERE c.rel = 'CONTAINS'""", *INDEX_CTES)


def d13(spark, sf):
    return G.function_details(*_index(spark, sf)).select(
        "id", "name", "file_path", "language", "complexity", "n_calls", "n_called_by"
    )


D13_SQL = with_files("""
SELECT n.id, n.name, f.path AS file_path, f.language, n.complexity,
  (SELECT count(DISTINCT dst) FROM edges e WHERE e.src = n.id AND e.rel = 'CALLS') AS n_calls,
  (SELECT count(DISTINCT src) FROM edges e WHERE e.dst = n.id AND e.rel = 'CALLS') AS n_called_by
FROM nodes n LEFT JOIN edges d ON d.dst = n.id AND d.rel = 'DEFINES' LEFT JOIN nodes f ON f.id = d.src
WHERE n.label = 'Function'""", *INDEX_CTES)


def e3(spark, sf):
    return G.repository_statistics(*_index(spark, sf)).select(
        "repo_id", "files", "functions", "classes"
    )


E3_SQL = with_files("""
SELECT repo_id, count(*) FILTER (label = 'File') AS files,
  count(*) FILTER (label = 'Function') AS functions, count(*) FILTER (label = 'Class') AS classes
FROM nodes GROUP BY repo_id""", *INDEX_CTES)


def e3_languages(spark, sf):
    return G.language_statistics(*_index(spark, sf)).select(
        "repo_id", F.coalesce("language", F.lit("-")).alias("language"), "files"
    )


E3_LANGUAGES_SQL = with_files("""SELECT repo_id, coalesce(language, '-') AS language, count(*) AS files
FROM code_files GROUP BY ALL""")


def e4(spark, sf):
    """Lines, average complexity and last change of each repository."""
    stats = G.repository_statistics(*_index(spark, sf))
    events = table(spark, sf, "events")
    repo = F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string"))
    changed = events.groupBy(repo.alias("repo_id")).agg(
        F.unix_micros(F.max("ts").cast("timestamp")).alias("last_updated")
    )
    return stats.join(changed, "repo_id", "left").select(
        "repo_id", "total_lines", F.round("average_complexity", 6).alias("average_complexity"),
        "last_updated",
    )


E4_SQL = with_files("""
SELECT n.repo_id, CAST(sum(lines) AS BIGINT) AS total_lines,
  round(sum(complexity) / count(*) FILTER (label = 'Function'), 6) AS average_complexity,
  max(u.last_updated) AS last_updated
FROM nodes n LEFT JOIN (SELECT concat('repo', user_id % 5) AS repo_id,
    epoch_us(max(ts)) AS last_updated FROM events GROUP BY 1) u USING (repo_id)
GROUP BY n.repo_id""", *INDEX_CTES)


def e4_lines(spark, sf):
    """Lines by language, the map written out."""
    found = G.language_lines(*_index(spark, sf))
    return found.select("repo_id", F.array_join(F.transform(
        F.map_entries("lines"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("lines"))


E4_LINES_SQL = with_files("""SELECT repo_id, string_agg(concat(language, '=', n), ',' ORDER BY language) AS lines
FROM (SELECT repo_id, language, sum(len(string_split(content, chr(10)))) AS n FROM code_files
  WHERE language IS NOT NULL GROUP BY ALL) GROUP BY repo_id""")


def d13_neighbours(spark, sf):
    return G.function_neighbours(_index(spark, sf)[1])


D13_NEIGHBOURS_SQL = with_files("""
SELECT DISTINCT src AS id, 'calls' AS direction, dst AS neighbour FROM edges WHERE rel = 'CALLS'
UNION ALL SELECT DISTINCT dst, 'called_by', src FROM edges WHERE rel = 'CALLS'""", *INDEX_CTES)


def c6(spark, sf):
    nodes, _ = _index(spark, sf)
    return G.search_nodes(nodes, "load").select(
        "id", "type", "name", F.coalesce("file_path", F.lit("-")).alias("file_path"), "score"
    )


_SEARCH = """hits AS (SELECT id, label AS type, coalesce(nullif(name, ''), path, 'Unknown') AS name,
    path AS file_path, CASE WHEN contains(coalesce(name, ''), '{q}') THEN 1.0 ELSE 0.5 END AS score
  FROM nodes WHERE contains(coalesce(name, ''), '{q}') OR contains(coalesce(path, ''), '{q}'))"""
C6_SQL = with_files(
    "SELECT id, type, name, coalesce(file_path, '-') AS file_path, CAST(score AS DOUBLE) AS score"
    " FROM hits", *INDEX_CTES, _SEARCH.format(q="load"))


def b32(spark, sf):
    nodes, _ = _index(spark, sf)
    return G.search_nodes(nodes, "1").groupBy("type", "score").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name")
    )


B32_SQL = with_files("""SELECT type, CAST(score AS DOUBLE) AS score, count(*) AS n,
  min(name) AS first_name FROM hits GROUP BY ALL""", *INDEX_CTES, _SEARCH.format(q="1"))


def h3(spark, sf):
    """Names that hold a word, and functions whose source is nearest to it."""
    nodes, _ = _index(spark, sf)
    snippets = G.function_snippets(code_files(spark, sf))
    hits = SE.hybrid_search(
        nodes, "load", SE.semantic_hits(snippets, "load", limit=50), "hybrid", limit=50)
    return hits.select("id", "type", "name", F.round("score", 6).alias("score"), "source")


# Cosines of hashed word counts; both engines divide the same whole numbers.
_TERMS = """{name} AS (
  SELECT id, bucket, count(*) AS tf FROM (
    SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 1048576 AS bucket FROM (
      SELECT id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM ({texts})))
  GROUP BY ALL)"""
_SCORES = """scored AS (
  SELECT q.id AS query_id, d.id, sum(q.tf * d.tf)::DOUBLE / sqrt(any_value(qn)::DOUBLE * any_value(dn)::DOUBLE) AS score
  FROM asked q JOIN found d USING (bucket)
  JOIN (SELECT id, sum(tf * tf) AS qn FROM asked GROUP BY id) a ON a.id = q.id
  JOIN (SELECT id, sum(tf * tf) AS dn FROM found GROUP BY id) b ON b.id = d.id
  GROUP BY q.id, d.id)"""
H3_SQL = with_files("""SELECT id, type, name, score, source FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source) AS rn FROM (
    (SELECT id, type, name, round(CAST(score AS DOUBLE), 6) AS score, 'graph' AS source FROM hits
      ORDER BY score DESC, id LIMIT 50)
    UNION ALL
    (SELECT id, 'Snippet', name, round(s.score, 6) AS score, 'semantic'
      FROM scored s JOIN snippets USING (id) ORDER BY s.score DESC, id LIMIT 50)))
WHERE rn = 1 ORDER BY score DESC, id LIMIT 50""",
                    *INDEX_CTES, _SEARCH.format(q="load"),
                    """snippets AS (SELECT md5(concat(f.repo_id, ':', f.path, ':', f.name)) AS id, f.name,
  array_to_string(string_split(c.content, chr(10))[f.start_line:f.end_line], chr(10)) AS text
  FROM last_functions f JOIN code_files c USING (repo_id, path))""",
                    _TERMS.format(name="found", texts="SELECT id, text FROM snippets"),
                    _TERMS.format(name="asked", texts="SELECT 0 AS id, 'load' AS text"), _SCORES)


def f2(spark, sf):
    """Best hit per node over several searches at once."""
    nodes, _ = _index(spark, sf)
    hits = None
    for word in ("load", "K", "f1", "eval"):
        part = G.search_nodes(nodes, word).withColumn("source", F.lit(word))
        hits = part if hits is None else hits.unionByName(part)
    return U.latest_by(hits, ["id"], F.desc("score"), F.asc("source")).select(
        "id", "name", "score", "source"
    )


F2_SQL = with_files("""SELECT id, name, score, source FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY score DESC, source) AS rn FROM (SELECT id, coalesce(nullif(name, ''), path) AS name, word AS source,
    CAST(CASE WHEN contains(coalesce(name, ''), word) THEN 1.0 ELSE 0.5 END AS DOUBLE) AS score
  FROM nodes JOIN (VALUES ('load'), ('K'), ('f1'), ('eval')) w(word)
    ON contains(coalesce(name, ''), word) OR contains(coalesce(path, ''), word))) WHERE rn = 1""",
                    *INDEX_CTES)

# --- call graph from lineitem ------------------------------------------------------


def _links(spark, sf):
    items = table(spark, sf, "lineitem")
    size = items.agg((F.max("l_partkey") + 1).alias("n")).scalar()
    return items.select(
        F.col("l_partkey").alias("src"),
        ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % size).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "indirect").otherwise("direct").alias("type"),
    )


def _root(links):
    """The node with most distinct callees, lowest id first."""
    return (
        links.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("d"))
        .orderBy(F.desc("d"), "src").limit(1).select(F.col("src").alias("id"))
    )


LINKS = """links AS (SELECT l_partkey AS src, (l_orderkey * 13 + l_linenumber)
    % (SELECT max(l_partkey) + 1 FROM lineitem) AS dst,
    CASE l_returnflag WHEN 'R' THEN 'indirect' ELSE 'direct' END AS type FROM lineitem),
simple AS (SELECT DISTINCT src, dst FROM links),
root AS (SELECT src AS id FROM simple GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"""
HOPS = """hops AS (SELECT id, min(hop) AS hop FROM (
  SELECT id, 0 AS hop FROM root
  UNION SELECT dst, 1 FROM root JOIN simple ON src = id
  UNION SELECT b.dst, 2 FROM root JOIN simple a ON a.src = id JOIN simple b ON b.src = a.dst)
  GROUP BY id)"""


def d14_nodes(spark, sf):
    links = _links(spark, sf)
    return G.reachable(links, _root(links), depth=2)


def d14_edges(spark, sf):
    links = _links(spark, sf)
    return G.reachable_edges(links, _root(links), depth=2)


def h4(spark, sf):
    links = _links(spark, sf)
    return G.reachable(links, _root(links), depth=3).groupBy("hop").agg(
        F.count(F.lit(1)).alias("n")
    )


H4_SQL = f"""WITH RECURSIVE {LINKS}, walk AS (SELECT id, 0 AS hop FROM root
  UNION SELECT dst, hop + 1 FROM walk JOIN simple ON src = id WHERE hop < 3)
SELECT hop, count(*) AS n FROM (SELECT id, min(hop) AS hop FROM walk GROUP BY id) GROUP BY hop"""


def g6(spark, sf):
    links = _links(spark, sf)
    root = _root(links).first()["id"]
    paths = G.first_paths(links, root, depth=3, limit=100)
    return paths.select(F.concat_ws(">", F.transform("path", lambda p: p.cast("string"))).alias("path"))


G6_SQL = f"""WITH {LINKS}, one AS (SELECT [id, dst] AS path FROM root JOIN simple ON src = id),
two AS (SELECT list_append(path, dst) AS path FROM one JOIN simple ON src = path[2]
  WHERE NOT (src = path[1] AND dst = path[2])),
three AS (SELECT list_append(path, dst) AS path FROM two JOIN simple ON src = path[3]
  WHERE NOT (src = path[1] AND dst = path[2]) AND NOT (src = path[2] AND dst = path[3]))
SELECT array_to_string(path, '>') AS path FROM (SELECT path FROM one UNION ALL SELECT path FROM two
  UNION ALL SELECT path FROM three) ORDER BY list_transform(path, lambda x: x) LIMIT 100"""


def e7(spark, sf):
    """Distinct callees and callers of every node."""
    links = _links(spark, sf).withColumn("rel", F.lit(G.CALLS))
    return G.function_neighbours(links).groupBy("id", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.min("neighbour").alias("first_id")
    )


E7_SQL = f"""WITH {LINKS} SELECT src AS id, 'calls' AS direction, count(*) AS n, min(dst) AS first_id
  FROM simple GROUP BY src
UNION ALL SELECT dst, 'called_by', count(*), min(src) FROM simple GROUP BY dst"""

# --- upserts and deletes --------------------------------------------------------------


def _customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("parent_id"), F.col("c_acctbal").alias("score"),
    )


def a11(spark, sf):
    """Customers updated from orders; orders of unknown customers add nothing."""
    existing = _customers(spark, sf)
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"),
        (F.col("o_custkey") % 30).alias("parent_id"), F.col("o_totalprice").alias("score"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    parents = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    return U.upsert_children(existing, updates, parents, "parent_id", "seq").drop("seq")


A11_SQL = """SELECT id, name, parent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY is_new DESC, d DESC NULLS LAST, k DESC) AS rn FROM (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS parent_id, c_acctbal AS score, 0 AS is_new,
    NULL AS d, NULL AS k FROM customer
  UNION ALL SELECT o_custkey, o_orderpriority, o_custkey % 30, o_totalprice, 1, o_orderdate, o_orderkey
    FROM orders WHERE o_custkey % 30 IN (SELECT n_nationkey FROM nation))) WHERE rn = 1"""


def a11_stored(spark, sf):
    """Stored customers updated from open, then partly shipped, then finished orders."""
    path = scratch_dir(spark, "customers")
    write_store(_customers(spark, sf), path, ["id"], 16)
    for status in ("O", "P", "F"):
        updates = table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(
            F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"),
            (F.col("o_custkey") % 30).alias("parent_id"), F.col("o_totalprice").alias("score"),
            F.struct("o_orderdate", "o_orderkey").alias("seq"),
        )
        upsert_store(spark, path, updates, ["id"], "seq", 16)
    return read_store(spark, path)


A11_STORED_SQL = """SELECT id, name, parent_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC, d DESC, k DESC) AS rn FROM (
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS parent_id, c_acctbal AS score, 0 AS step,
      NULL AS d, NULL AS k FROM customer
    UNION ALL SELECT o_custkey, o_orderpriority, o_custkey % 30, o_totalprice,
      CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, o_orderdate, o_orderkey
      FROM orders WHERE o_orderstatus IN ('O', 'P', 'F'))) WHERE rn = 1"""


def a12(spark, sf):
    links = _links(spark, sf).withColumn("rel", F.lit("CALLS"))
    nodes = table(spark, sf, "part").filter(F.col("p_size") > 10).select(F.col("p_partkey").alias("id"))
    existing = table(spark, sf, "part").select(
        F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"),
        F.lit("CALLS").alias("rel"), F.lit("direct").alias("type"),
    )
    return U.upsert_edges(existing, links, nodes)


A12_SQL = f"""WITH {LINKS} SELECT p_partkey AS src, p_partkey AS dst, 'CALLS' AS rel, 'direct' AS type FROM part
UNION SELECT src, dst, 'CALLS', type FROM links
  WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 10)
    AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def a13(spark, sf):
    """Vectors re-inserted under half of their ids replace the old ones."""
    existing = _vectors(spark, sf)
    fresh = existing.select(
        F.floor(F.col("id") / 2).cast("bigint").alias("id"), "embedding",
        (F.col("label") + 100).cast("int").alias("label"), F.col("id").alias("seq"),
    )
    merged = U.upsert(existing, fresh, ["id"], "seq")
    return merged.select("id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


A13_SQL = """SELECT id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_new DESC, seq DESC) AS rn FROM (
    SELECT vec_id AS id, embedding, label, 0 AS is_new, 0 AS seq FROM embeddings
    UNION ALL SELECT vec_id // 2, embedding, label + 100, 1, vec_id FROM embeddings)) WHERE rn = 1"""


def a14(spark, sf):
    """Files named in labels are re-indexed under a new name for each function."""
    files = code_files(spark, sf)
    changed = table(spark, sf, "labels").select(F.col("doc_id").alias("file_id"))
    old = S.functions(files).select("file_id", "name", "start_line")
    fresh = old.filter(~F.col("name").startswith("__")).withColumn(
        "name", F.concat("name", F.lit("_v2"))
    )
    return U.replace_by(old, fresh, changed, "file_id")


A14_SQL = with_files("""
SELECT file_id, name, start_line FROM measured WHERE kind = 'function'
  AND file_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT file_id, concat(name, '_v2'), start_line FROM measured WHERE kind = 'function'
  AND NOT starts_with(name, '__') AND file_id IN (SELECT doc_id FROM labels)""", *FUNCTIONS)


def a15(spark, sf):
    nodes, edges = G.delete_repository(*_index(spark, sf), "repo1")
    return nodes.groupBy("repo_id", F.col("label").alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    ).unionByName(
        edges.groupBy(F.lit("-").alias("repo_id"), F.col("rel").alias("kind")).agg(
            F.count(F.lit(1)).alias("n"))
    )


A15_SQL = with_files("""
SELECT repo_id, label AS kind, count(*) AS n FROM nodes WHERE repo_id <> 'repo1' GROUP BY ALL
UNION ALL SELECT '-', rel, count(*) FROM edges
  WHERE src NOT IN (SELECT id FROM nodes WHERE repo_id = 'repo1')
    AND dst NOT IN (SELECT id FROM nodes WHERE repo_id = 'repo1') GROUP BY rel""", *INDEX_CTES)


def a17(spark, sf):
    orders = table(spark, sf, "orders")
    as_of = orders.agg(F.max("o_orderdate").alias("d")).scalar()
    return U.retention_counts(orders, "o_orderdate", as_of, 365)


A17_SQL = """SELECT count(*) FILTER (o_orderdate < m - INTERVAL 365 DAYS) AS deleted_count,
  count(*) FILTER (o_orderdate >= m - INTERVAL 365 DAYS) AS kept_count
FROM orders, (SELECT max(o_orderdate) AS m FROM orders)"""


def d17(spark, sf):
    """Line items whose order and part both exist."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = table(spark, sf, "part").filter(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("l_partkey"))
    return (
        table(spark, sf, "lineitem").join(orders, "l_orderkey", "left_semi")
        .join(parts, "l_partkey", "left_semi")
        .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    )


D17_SQL = """SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1"""


def f3(spark, sf):
    """Latest turn of each conversation and role."""
    turns = table(spark, sf, "conversations")
    return U.latest_by(turns, ["conv_id", "role"], F.desc("turn")).select(
        "conv_id", "role", "turn", F.md5("text").alias("hash")
    )


F3_SQL = """SELECT conv_id, role, max(turn) AS turn, md5(arg_max(text, turn)) AS hash
FROM conversations GROUP BY conv_id, role"""

# --- vectors ----------------------------------------------------------------------


def d15(spark, sf):
    vectors = _vectors(spark, sf)
    query = vectors.groupBy().agg(F.min_by("embedding", "id").alias("e")).first()["e"]
    return V.find_similar(vectors, query, limit=10).select("id", F.round("score", 6).alias("score"))


_COSINE = """round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
    / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))
    / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 9)"""
D15_SQL = f"""SELECT id, round(s, 6) AS score FROM (SELECT v.vec_id AS id, {_COSINE} AS s FROM embeddings v,
  (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY s DESC, id LIMIT 10"""


def g2(spark, sf):
    """Five nearest vectors of each label's first vector: one query per label."""
    vectors = _vectors(spark, sf)
    queries = vectors.groupBy("label").agg(F.min("id").alias("query_id"),
                                           F.min_by("embedding", "id").alias("embedding"))
    return V.nearest(queries.select("query_id", "embedding"), vectors, k=5).select(
        "query_id", "id", F.round("score", 6).alias("score"), "rank"
    )


G2_SQL = f"""SELECT query_id, id, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
    SELECT q.query_id, v.vec_id AS id, {_COSINE} AS s FROM embeddings v, (SELECT min(vec_id) AS query_id,
      arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q)) WHERE rank <= 5"""


def c7(spark, sf):
    vectors = _vectors(spark, sf).withColumn("language", F.col("label").cast("string"))
    query = vectors.groupBy().agg(F.max_by("embedding", "id").alias("e")).first()["e"]
    return V.find_similar(vectors, query, language="1", limit=20).select(
        "id", F.round("score", 6).alias("score")
    )


C7_SQL = f"""SELECT id, round(s, 6) AS score FROM (SELECT v.vec_id AS id, {_COSINE} AS s FROM embeddings v,
  (SELECT embedding FROM embeddings ORDER BY vec_id DESC LIMIT 1) q WHERE v.label = 1)
ORDER BY s DESC, id LIMIT 20"""


def b27(spark, sf):
    """Distance and score of every vector to the first one."""
    vectors = _vectors(spark, sf)
    query = vectors.groupBy().agg(F.min_by("embedding", "id").alias("e")).first()["e"]
    unit = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
        lambda s, x: s + x)
    v = F.col("embedding")
    cosine = dot(v, unit) / F.sqrt(dot(v, v)) / F.sqrt(dot(unit, unit))
    return vectors.withColumn("distance", F.lit(1.0) - cosine).groupBy("label").agg(
        F.round(F.max(F.lit(1.0) - F.col("distance")), 6).alias("best"),
        F.round(F.min(F.lit(1.0) - F.col("distance")), 6).alias("worst"),
    )


B27_SQL = f"""SELECT label, round(max(s), 6) AS best, round(min(s), 6) AS worst FROM (
  SELECT v.label, {_COSINE} AS s FROM embeddings v,
    (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) GROUP BY label"""


def d16(spark, sf):
    """Benchmark texts as queries against all documents."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return TI.search(TI.build_index(documents), queries, k=3).select(
        "query_id", "id", F.round("score", 6).alias("score"), "rank")


D16_SQL = "WITH " + ",\n".join([
    _TERMS.format(name="found", texts="SELECT doc_id AS id, text FROM documents"),
    _TERMS.format(name="asked", texts="SELECT item_id AS id, text FROM benchmark"), _SCORES,
]) + """ SELECT query_id, id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored
QUALIFY rank <= 3"""


QUERIES = {
    "a11_node_upsert": (a11, A11_SQL),
    "a11_stored_upsert": (a11_stored, A11_STORED_SQL),
    "a12_edge_upsert": (a12, A12_SQL),
    "a13_vector_upsert": (a13, A13_SQL),
    "a14_incremental_reindex": (a14, A14_SQL),
    "a15_cascade_delete": (a15, A15_SQL),
    "a17_retention": (a17, A17_SQL),
    "a18_index_job": (a18, A18_SQL),
    "e15_index_counters": (e15, E15_SQL),
    "d12_containment": (d12, D12_SQL),
    "d13_function_details": (d13, D13_SQL),
    "d14_reachable_nodes": (d14_nodes, f"WITH {LINKS}, {HOPS} SELECT id, hop FROM hops"),
    "d14_reachable_edges": (d14_edges, f"""WITH {LINKS}, {HOPS} SELECT DISTINCT src, dst, type FROM links
  WHERE src IN (SELECT id FROM hops WHERE hop < 2)"""),
    "d15_nearest_vectors": (d15, D15_SQL),
    "d16_semantic_search": (d16, D16_SQL),
    "d17_existence_join": (d17, D17_SQL),
    "e3_repository_statistics": (e3, E3_SQL),
    "e3_language_statistics": (e3_languages, E3_LANGUAGES_SQL),
    "e4_extended_statistics": (e4, E4_SQL),
    "e4_language_lines": (e4_lines, E4_LINES_SQL),
    "d13_neighbours": (d13_neighbours, D13_NEIGHBOURS_SQL),
    "e6_vector_count": (
        lambda spark, sf: _vectors(spark, sf).agg(F.count(F.lit(1)).alias("total_vectors")),
        "SELECT count(*) AS total_vectors FROM embeddings"),
    "e7_neighbours": (e7, E7_SQL),
    "c6_node_search": (c6, C6_SQL),
    "c7_filtered_neighbours": (c7, C7_SQL),
    "b27_scores": (b27, B27_SQL),
    "b32_search_rows": (b32, B32_SQL),
    "f2_best_hit": (f2, F2_SQL),
    "f3_last_write_wins": (f3, F3_SQL),
    "g2_top_k": (g2, G2_SQL),
    "g6_first_paths": (g6, G6_SQL),
    "h3_hybrid_search": (h3, H3_SQL),
    "h4_distinct_nodes": (h4, H4_SQL),
}
