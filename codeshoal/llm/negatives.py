"""Hard-negative mining: bounds along a spanning tree of the anchors spare most scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

# Anchors of one tree and candidates of one block, about.
TREE, BLOCK = 1024, 4096
# Whole numbers are exact in doubles below this.
EXACT = 2.0 ** 53
MOST = 2 ** 63 - 1
# The smallest and the largest score of a negative in percent of the positive's.
LEAST_SHARE, MOST_SHARE = 50, 95


def spanning_tree(points: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Order, parents and edge lengths of a minimum spanning tree (Prim) over the rows.

    The root is the row nearest the mean and has parent -1; rows come depth first.
    """
    n = len(points)
    root = int(np.argmin(np.square(points - points.mean(axis=0)).sum(axis=1)))
    near = np.full(n, np.inf)
    parent = np.full(n, -1)
    left = np.ones(n, bool)
    at = root
    for _ in range(n):
        left[at] = False
        apart = np.sqrt(np.square(points - points[at]).sum(axis=1))
        closer = left & (apart < near)
        near[closer], parent[closer] = apart[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
    near[root] = 0.0
    children: list[list[int]] = [[] for _ in range(n)]
    for row, above in enumerate(parent.tolist()):
        if above >= 0:
            children[above].append(row)
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(children[at])
    return order, parent.tolist(), near


class Scores:
    """Whole scores of candidates with anchors, along a spanning tree of the anchors.

    A candidate's score with an anchor lies within its bounds for the parent anchor plus or minus
    the edge's length times the candidate's norm.  Candidates whose bounds overlap the window
    asked for are scored anew, exactly, and their bounds shrink to the score.  The rows with
    components too large for exact doubles (``wide``) are all scored, in Python's whole numbers.
    """

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray, scale: int):
        self.scale = scale
        self.raw = anchors, candidates
        with np.errstate(over="ignore"):
            floors = [np.floor(scale * x) for x in self.raw]
            wide = [(np.square(x) * max(x.shape[1], 1) >= EXACT).any(axis=1) for x in floors]
        self.narrow_anchors, self.narrow = (np.flatnonzero(~w) for w in wide)
        self.wide_anchors, self.wide = (np.flatnonzero(w) for w in wide)
        self.anchors = floors[0][self.narrow_anchors]
        self.candidates = floors[1][self.narrow]
        self.scored = 0

    def rescored(self, overlaps: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their scores) for each anchor; the others are out of its window.

        ``overlaps(anchor, which, low, high)`` marks those of the candidates ``which`` that the
        anchor's window overlaps.
        """
        if len(self.narrow_anchors):
            yield from self._along_tree(overlaps)
        every = np.arange(len(self.raw[1]))
        for anchor in self.wide_anchors:
            yield int(anchor), every, self._whole(anchor, every)

    def _along_tree(self, overlaps: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order, parent, edges = spanning_tree(self.anchors)
        norms = np.sqrt(np.square(self.candidates).sum(axis=1)) * (1 + 1e-9)
        waiting = np.bincount([p for p in parent if p >= 0], minlength=len(order))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at in order:
            anchor = int(self.narrow_anchors[at])
            above = parent[at]
            if above < 0:
                low, high = (np.full(len(norms), x) for x in (-np.inf, np.inf))
                which = np.arange(len(norms))
            else:
                # One more than rounding could take from a bound.
                reach = edges[at] * (1 + 1e-9) * norms + 1.0
                low, high = bounds[above][0] - reach, bounds[above][1] + reach
                waiting[above] -= 1
                if not waiting[above]:
                    del bounds[above]
                which = np.flatnonzero(overlaps(anchor, self.narrow, low, high))
            found = self.candidates[which] @ self.anchors[at]
            low[which] = high[which] = found
            if waiting[at]:
                bounds[at] = low, high
            self.scored += len(which)
            found = found.astype(np.int64)
            if len(self.wide):
                yield (anchor, np.concatenate([self.narrow[which], self.wide]),
                       np.concatenate([found, self._whole(anchor, self.wide)]))
            else:
                yield anchor, self.narrow[which], found

    def _whole(self, anchor: int, which: np.ndarray) -> np.ndarray:
        left = [self._floor(x) for x in self.raw[0][anchor].tolist()]
        sums = (sum(a * self._floor(x) for a, x in zip(left, row))
                for row in self.raw[1][which].tolist())
        return np.fromiter((max(-MOST, min(MOST, s)) for s in sums), np.int64, len(which))

    def _floor(self, x: float) -> int:
        return floor(x * self.scale) if abs(x) < EXACT else int(x) * self.scale


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(table), len(flat) // max(len(table), 1))


def _in_order(table: pa.Table) -> pa.Table:
    """Candidates in the order in which ties are broken: by vec_id (null last), then by row."""
    return table.sort_by([("vec_id", "ascending"), ("uid", "ascending")])


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest scores, ties to the smaller place."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((places[some], -scores[some]))][:k]


POSITIVE = pa.schema([("anchor", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()),
                      ("score", pa.int64())])
NEGATIVE = pa.schema([
    ("anchor", pa.int64()), ("positive", pa.int64()), ("anchor_id", pa.int64()),
    ("positive_id", pa.int64()), ("uid", pa.int64()), ("negative_id", pa.int64()),
    ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _positives(k: int, scale: int) -> Callable:
    """The k best candidates of each anchor, but for itself; all have its label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            right = _in_order(right)
            uids, ids = right["uid"].to_numpy(), right["vec_id"].to_pylist()
            own = left["uid"].to_pylist()

            def overlaps(anchor, which, low, high):
                other = uids[which] != own[anchor]
                lows = low[other]
                least = np.partition(lows, len(lows) - k)[len(lows) - k] if len(lows) > k else -np.inf
                return other & (high >= least)

            scores = Scores(_vectors(left), _vectors(right), scale)
            for a, which, found in scores.rescored(overlaps):
                other = uids[which] != own[a]
                which, found = which[other], found[other]
                rows.extend((own[a], int(uids[which[i]]), ids[which[i]], int(found[i]))
                            for i in _best(found, which, k))
        return _table(rows, POSITIVE)

    return run


def _window(score: int) -> tuple[int, int]:
    """Least and largest score of a positive's negatives (none if they cross)."""
    return -(-LEAST_SHARE * score // 100), MOST_SHARE * score // 100


def _negatives(k: int, scale: int) -> Callable:
    """For each anchor and positive the k best candidates of other labels within its window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            right = _in_order(right)
            uids, ids = right["uid"].to_numpy(), right["vec_id"].to_pylist()
            names: dict = {}
            labels = np.array([names.setdefault(x, len(names)) for x in right["label"].to_pylist()])
            own = [names.get(x, -1) for x in left["label"].to_pylist()]
            anchors, anchor_ids = left["uid"].to_pylist(), left["vec_id"].to_pylist()
            positives = left["positives"].to_pylist()

            def overlaps(anchor, which, low, high):
                foreign = labels[which] != own[anchor]
                asked = np.zeros(len(which), bool)
                for least, most in {_window(p["score"]) for p in positives[anchor]}:
                    if least > most:
                        continue
                    sure = low[foreign & (low >= least) & (high <= most)]
                    floor_ = least
                    if len(sure) > k:
                        floor_ = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
                    asked |= (high >= floor_) & (low <= most)
                return foreign & asked

            scores = Scores(_vectors(left), _vectors(right), scale)
            for a, which, found in scores.rescored(overlaps):
                foreign = labels[which] != own[a]
                which, found = which[foreign], found[foreign]
                for p in positives[a]:
                    least, most = _window(p["score"])
                    inside = np.flatnonzero((found >= least) & (found <= most))
                    for i in inside[_best(found[inside], which[inside], k)]:
                        rows.append((
                            anchors[a], p["uid"], anchor_ids[a], p["vec_id"], int(uids[which[i]]),
                            ids[which[i]], p["score"], int(found[i])))
        return _table(rows, NEGATIVE)

    return run


def usable(rows: DataFrame, anchor: Column) -> DataFrame:
    """(vec_id, label, embedding, dim, is_anchor) of the rows that take part.

    A null label or vector, or a null or non-finite component, takes a row out.
    """
    sound = F.forall("embedding", lambda x: F.coalesce(
        F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return rows.select(
        F.col("vec_id").cast("long"), "label", "embedding", F.size("embedding").alias("dim"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor")
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)


def _again(*names: str) -> list[Column]:
    """Columns as new ones: a frame is grouped with another that comes from the same rows."""
    return [F.col(name).alias(name) for name in names]


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("long")


def _dealt(parts: Column) -> Column:
    """A part of 0 .. parts - 1 for a row, by the hash of its number."""
    return F.pmod(F.xxhash64("uid"), parts)


def _all(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def mine_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` marks the anchor rows.  Vectors are made whole by ``floor(scale * x)``; a score is the
    inner product with the anchor, held at the ends of a long if it passes them.  An anchor's
    positives are its ``positives`` best other rows of the same label (all, if fewer); for each, the
    first ``negatives`` rows of other labels with a score from 50 to 95 percent of the
    positive's are returned (all, if fewer; none for a score below 0).  Higher scores
    come first, ties by vec_id (null last), then in the order of the rows.

    Rows with a null label or vector, or with a null or non-finite component, take no part.  Vectors
    meet only those of their own length.  Repeated rows are rows of their own: each can be anchor,
    positive and negative.  Empty tables give no rows; other columns are ignored.

    All anchors meet all rows, in blocks: a task takes one tree of anchors (of like labels) and
    one block of candidates, and gives its best few for each anchor.
    """
    base = stash(usable(rows, anchor).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    of_label = base.groupBy("dim", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"))
    sized = of_label.withColumn("trees", _parts(F.col("anchors"), TREE)).withColumn(
        "blocks", _parts(F.col("n"), BLOCK)).where("anchors > 0")
    placed = base.join(sized.select("dim", "label", "trees", "blocks"), ["dim", "label"])
    keys = ["dim", "label", "tree", "block"]
    left = placed.where("is_anchor").select(
        "dim", "label", "uid", "vec_id", "embedding", _dealt(F.col("trees")).alias("tree"),
        _all(F.col("blocks")).alias("block"))
    right = placed.select(
        *_again("dim", "label", "uid", "vec_id", "embedding"), _dealt(F.col("blocks")).alias("block"),
        _all(F.col("trees")).alias("tree"))
    near = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(
        _positives(positives, scale), "anchor long, uid long, vec_id long, score long")
    first = Window.partitionBy("anchor").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    best = near.withColumn("rank", F.row_number().over(first)).where(
        F.col("rank") <= positives).groupBy(F.col("anchor").alias("uid")).agg(
        F.collect_list(F.struct("uid", "vec_id", "score")).alias("positives"))
    best = stash(best, "positives")

    # Trees of all labels: anchors of a label lie together, a common label in several trees.
    in_dim = of_label.groupBy("dim").agg(
        _parts(F.sum("n"), BLOCK).alias("blocks"), _parts(F.sum("anchors"), TREE).alias("trees"))
    anchors = base.where("is_anchor").join(best, "uid").join(
        of_label.select("dim", "label", "anchors"), ["dim", "label"]).join(in_dim, "dim")
    left = anchors.select(
        "dim", "label", "uid", "vec_id", "embedding", "positives",
        F.pmod(F.xxhash64("label") + _dealt(_parts(2 * F.col("anchors"), TREE)), F.col("trees")
               ).alias("tree"), _all(F.col("blocks")).alias("block"))
    right = base.join(in_dim.where("trees > 0"), "dim").select(
        *_again("dim", "label", "uid", "vec_id", "embedding"), _dealt(F.col("blocks")).alias("block"),
        _all(F.col("trees")).alias("tree"))
    keys = ["dim", "tree", "block"]
    far = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(
        _negatives(negatives, scale),
        "anchor long, positive long, anchor_id long, positive_id long, uid long, "
        "negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor", "positive").orderBy(
        F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "uid")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH base AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)])::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id
                          )::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
