"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node that each node of ``edges(a, b)`` reaches, itself included.

    Every edge points from its larger to its smaller end.  A round first hangs each
    node on the least parent of its parents (large star), then joins all parents of
    a node under the least of them (small star).  It ends when each node has one
    parent and no parent has one itself.  Minima combine before they are shuffled
    and the joins are plain sort-merge joins, which Spark splits where a hub is
    skewed; no neighbour list is ever gathered.  Self loops and edges with a null
    end are left out; no edges give no rows.
    """
    pairs = stash(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        .distinct(),
        label,
    )
    while True:
        state = pairs.join(
            pairs.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi"
        ).limit(1).count()
        several = pairs.groupBy("node").count().where("count > 1").limit(1).count()
        if not state and not several:
            roots = pairs.select(F.col("parent").alias("node"), "parent").distinct()
            return pairs.unionByName(roots).withColumnRenamed("parent", "component")
        low = _lowest(pairs)
        hung = (
            pairs.join(low.select(F.col("node").alias("parent"), "low"), "parent", "left")
            .select("node", F.coalesce("low", "parent").alias("parent"))
            .distinct()
        )
        low = _lowest(hung)
        joined = hung.join(low, "node")
        pairs = stash(
            joined.select(F.explode(F.array(
                F.struct(F.col("node").alias("node"), F.col("low").alias("parent")),
                F.struct(F.col("parent").alias("node"), F.col("low").alias("parent")),
            )).alias("e"))
            .select("e.node", "e.parent")
            .where("node <> parent")
            .distinct(),
            label,
        )


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node").agg(F.min("parent").alias("low"))
