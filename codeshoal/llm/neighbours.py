"""Approximate nearest neighbours: stable projections, a kd-tree and a chi-square stop."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

DIMENSIONS = 16
# Chance that a neighbour at the distance of the k-th one found so far is still seen.
CONFIDENCE = 0.97
# The tree is fitted on about this many rows and has at most SAMPLE / 16 leaves.
SAMPLE, LEAF_ROWS = 20_000, 2_048
# Rows and queries of a leaf that meet in one task; more are cut by hash.
ROW_PIECE, QUERY_PIECE = 8_192, 1_024
FIRST_LEAVES = 3
STEP = 64


def chi_square_bound(confidence: float, freedom: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    z, spread = NormalDist().inv_cdf(confidence), 2 / (9 * freedom)
    return freedom * (1 - spread + z * math.sqrt(spread)) ** 3


class Tree:
    """A balanced kd-tree over projected vectors; node i has children 2i and 2i + 1."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.leaves, width = depth, 1 << depth, points.shape[1]
        self.axis = np.zeros(self.leaves, np.int64)
        self.cut = np.zeros(self.leaves)
        low = np.full((2 * self.leaves, width), -np.inf)
        high = np.full((2 * self.leaves, width), np.inf)
        held = {1: points}
        for node in range(1, self.leaves):
            own = held.pop(node)
            axis = int(np.argmax(own.std(axis=0))) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            for child, part in ((2 * node, own[:, axis] < cut), (2 * node + 1, own[:, axis] >= cut)):
                held[child] = own[part]
                low[child], high[child] = low[node], high[node]
            high[2 * node, axis] = cut
            low[2 * node + 1, axis] = cut
        self.low, self.high = low[self.leaves:], high[self.leaves:]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of each point."""
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + right
        return node - self.leaves

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap ** 2).sum(axis=1)


ROW = "uid long, vec_id long, width long, embedding array<double>, place array<double>"


def _projection(width: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(42).standard_normal((width, dimensions))


def _scaled(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors laid end to end, each divided by a power of two so that no square overflows.

    That changes no cosine: only exponents change.
    """
    if not len(flat):
        return flat
    largest = np.maximum.reduceat(np.abs(flat), ends - np.diff(ends, prepend=0))
    return np.ldexp(flat, -np.repeat(np.frexp(largest)[1], np.diff(ends, prepend=0)))


def _usable(vectors: DataFrame, dimensions: int) -> tuple[DataFrame, int]:
    """(uid, vec_id, width, embedding, place) of the rows that take part, and how many there are.

    ``uid`` tells rows of equal vec_id apart.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
        & F.exists("embedding", lambda x: x != 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            widths = pc.list_value_length(batch.column("embedding")).to_numpy().astype(np.int64)
            ends = np.cumsum(widths)
            flat = _scaled(flat, ends)
            place = np.zeros((len(widths), dimensions))
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                unit = flat[(ends[own] - width)[:, None] + np.arange(width)]
                unit = unit / np.sqrt((unit ** 2).sum(axis=1))[:, None]
                place[own] = unit @ _projection(width, dimensions)
            starts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("vec_id"), pa.array(widths),
                 pa.ListArray.from_arrays(starts, pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.ravel()))],
                names=["uid", "vec_id", "width", "embedding", "place"])

    placed = stash(good.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        project, ROW), "vectors")
    return placed, placed.count()


def _search(k: int, bound: float):
    """Function that verifies one leaf piece against the queries that visit it."""

    def run(_: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(queries):
            ids, uids = rows["vec_id"].to_numpy(), rows["uid"].to_numpy()
            vectors = np.array(rows["embedding"].tolist())
            places = np.array(rows["place"].tolist())
            norms = np.sqrt((vectors ** 2).sum(axis=1))
            for asked, embedding, place, reach in queries[
                    ["query", "embedding", "place", "reach"]].itertuples(index=False):
                query = np.asarray(embedding)
                norm = np.sqrt((query ** 2).sum())
                far = ((places - np.asarray(place)) ** 2).sum(axis=1)
                seen = np.flatnonzero((far <= bound * reach) & (uids != asked))
                seen = seen[np.argsort(far[seen], kind="stable")]
                best_id, best = np.zeros(0, np.int64), np.zeros(0)
                for start in range(0, len(seen), STEP):
                    part = seen[start:start + STEP]
                    # The nearest projections that are left are too far for a better one.
                    if far[part[0]] > bound * reach:
                        break
                    cosine = (vectors[part] * query).sum(axis=1) / (norms[part] * norm)
                    best_id = np.concatenate([best_id, ids[part]])
                    best = np.concatenate([best, cosine])
                    order = np.lexsort((best_id, -best))[:k]
                    best_id, best = best_id[order], best[order]
                    if len(best) == k:
                        reach = min(reach, 2 - 2 * best[-1] + 1e-12)
                found.extend((asked, i, s) for i, s in zip(best_id, best))
        return pd.DataFrame(found, columns=["query", "vec_id", "score"])

    return run


def _visit(rows: DataFrame, visits: DataFrame, k: int, bound: float) -> DataFrame:
    """Best ``k`` of each query in each leaf piece that it visits."""
    # One row per leaf and vector length, so at most SAMPLE / 16 for each length.
    pieces = F.broadcast(
        rows.groupBy("width", "leaf").agg(F.ceil(F.count("*") / ROW_PIECE).alias("row_pieces"))
        .join(visits.groupBy("width", "leaf").agg(
            F.ceil(F.count("*") / QUERY_PIECE).alias("query_pieces")), ["width", "leaf"]))
    left = rows.join(pieces, ["width", "leaf"]).select(
        "width", "leaf", F.pmod(F.xxhash64("uid"), "row_pieces").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_pieces") - 1)).alias("j"),
        "uid", "vec_id", "embedding", "place")
    right = visits.join(pieces, ["width", "leaf"]).select(
        "width", "leaf",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_pieces") - 1)).alias("i"),
        F.pmod(F.xxhash64("query"), "query_pieces").alias("j"),
        "query", "embedding", "place", "reach")
    by = ["width", "leaf", "i", "j"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(
        _search(k, bound), "query long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 5, dimensions: int = DIMENSIONS,
            confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine for each query row.

    ``is_query`` is a condition on vec_id.  Vectors (those with a null id, or null, zero or with
    null or non-finite components take no part; others meet vectors of their own length) are
    scaled to length one and projected by fixed normal variables.  A kd-tree, fitted on a
    bounded sample of the projections, gives every row a leaf.  A query first searches
    the nearest leaves; then all others whose box could hold a projection within the
    chi-square bound of the distance found.  In a leaf rows are verified in
    order of projected distance until that bound is passed.  Scores are cosines of the original
    vectors in double precision, ties go to the smaller vec_id.  Rows of a repeated
    id are rows of their own: each is searched, and is a candidate of the others.  Fewer
    candidates than ``k`` give fewer rows.
    """
    placed, total = _usable(vectors, dimensions)
    bound = chi_square_bound(confidence, dimensions)
    share = min(1.0, SAMPLE / max(total, 1))
    part = F.pmod(F.xxhash64("uid", F.lit("tree")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = placed.where(part < share).select("place").toPandas()["place"].tolist()
    points = np.array(sample) if sample else np.zeros((0, dimensions))
    wanted = min(max(1, total // LEAF_ROWS), max(1, len(points) // 16))
    tree = Tree(points, max(0, wanted.bit_length() - 1))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("place").flatten().to_numpy(zero_copy_only=False)
            leaf = tree.leaf(flat.reshape(-1, dimensions))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    rows = placed.mapInArrow(locate, f"{ROW}, leaf long")
    queries = placed.where(is_query).select(
        F.col("uid").alias("query"), "width", "embedding", "place")

    def route(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                listed = []
                for place, reach in zip(batch["place"], batch["reach"]):
                    gaps = tree.distances(np.asarray(place))
                    near = np.argsort(gaps, kind="stable")[:FIRST_LEAVES]
                    if not first:
                        others = np.flatnonzero(gaps <= bound * reach)
                        near = np.setdiff1d(others, near)
                    listed.append(near)
                sizes = [len(x) for x in listed]
                out = batch.loc[batch.index.repeat(sizes)].reset_index(drop=True)
                out["leaf"] = np.concatenate(listed) if listed else np.zeros(0, np.int64)
                yield out
        return run

    visit = "query long, width long, embedding array<double>, place array<double>, reach double, leaf long"
    # While fewer than k rows are known, none is too far.
    starts = queries.withColumn("reach", F.lit(float("inf")))
    near = stash(_best(_visit(
        rows, starts.mapInPandas(route(True), visit), k, bound), k).drop("rank"), "near")
    reached = near.groupBy("query").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    again = queries.join(reached, "query", "left").select(
        "query", "width", "embedding", "place",
        F.when(F.col("n") >= k, F.lit(2.0) - 2 * F.col("last"))
        .otherwise(float("inf")).alias("reach"))
    far = _visit(rows, again.mapInPandas(route(False), visit), k, bound)
    ids = placed.where(is_query).select(
        F.col("uid").alias("query"), F.col("vec_id").alias("query_id"))
    return _best(near.unionByName(far), k).join(ids, "query").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
