"""Hybrid search: graph and semantic hits in one ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import search_nodes
from .text_index import build_index, search
from .upserts import latest_by

RESULT = ("id", "type", "name", "file_path", "language", "score", "source")


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Best hits with ids breaking ties: a top-k per task, then of those."""
    return hits.orderBy(F.desc("score"), "id").limit(limit)


def combine(hits: DataFrame, limit: int) -> DataFrame:
    """Keep each id's best hit, then the best ``limit``; rows without id go."""
    present = hits.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    return top_hits(latest_by(present, ["id"], F.desc("score"), F.asc("source")), limit)


def semantic_hits(snippets: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None
                  ) -> DataFrame:
    """The snippets nearest to a text, as hits of ``hybrid_search``.

    ``index`` holds the postings of their contents (see ``text_index.build_index``); without
    one it is built.
    """
    asked = snippets.sparkSession.range(1).select(
        F.col("id").alias("query_id"), F.lit(query).alias("text"))
    index = build_index(snippets, text="content") if index is None else index
    found = search(index, asked, limit).select("id", "score")
    return snippets.join(found, "id").select(
        "id", F.lit("Snippet").alias("type"), F.col("function_name").alias("name"),
        F.col("path").alias("file_path"), "language", "score")


def hybrid_search(
    nodes: DataFrame,
    query: str,
    semantic: DataFrame | None = None,
    search_type: str = "hybrid",
    limit: int = 10,
) -> DataFrame:
    """Search nodes by text and merge with semantic hits (id, score, ...)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    parts = []
    if search_type in ("graph", "hybrid"):
        parts.append(
            top_hits(search_nodes(nodes, query), limit).withColumn("source", F.lit("graph"))
        )
    if search_type in ("semantic", "hybrid") and semantic is not None:
        parts.append(top_hits(semantic, limit).withColumn("source", F.lit("semantic")))
    if not parts:
        raise ValueError("search_type is semantic, graph or hybrid")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part, allowMissingColumns=True)
    return combine(hits, limit)
