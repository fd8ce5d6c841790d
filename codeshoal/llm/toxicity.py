"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, fresh, held_out, stash

ORDERS = (4, 5, 6)
STEP = 1 << 20
# Bytes of a text whose n-grams are made distinct at one time when a model is fitted.
PIECE = 1 << 23
# Rows that a step of the fit works on at a time.
ROWS = 128
# Slots of the table that tells most n-grams from those of a model.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The byte n-grams of the lower-cased text, some at a time and repeated ones too.

    An n-gram is its length and its bytes, packed into an integer; different ones never meet.
    """
    data = b" " + " ".join((text or "").lower().split()).encode() + b" "
    for start in range(0, len(data), STEP):
        part = np.frombuffer(data, np.uint8, min(STEP + max(ORDERS), len(data) - start), start)
        part = part.astype(np.int64)
        rolled = np.zeros(len(part), np.int64)
        for n in range(1, max(ORDERS) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            rolled = (rolled[:size] << 8) | part[n - 1:]
            if n in ORDERS:
                yield rolled | (n << 48)


def _mixed(slots: np.ndarray) -> np.ndarray:
    return (slots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The distinct n-grams of a text, sorted; those of a long one in several disjoint parts."""
    parts = -(-len(text or "") // PIECE) or 1
    for i in range(parts):
        seen = np.zeros(0, np.int64)
        for some in grams(text):
            some = some if parts == 1 else some[_mixed(some) % np.uint64(parts) == i]
            seen = np.union1d(seen, some)
        yield seen


class Model:
    """N-grams (sorted) with their log-count ratios and coefficients, and an intercept."""

    def __init__(self, slots: np.ndarray, ratio: np.ndarray, coef: np.ndarray, bias: float):
        self.bias = bias
        self.slots = np.asarray(slots, np.int64)
        self.weight = np.asarray(coef * ratio, np.float64)
        self.square = np.asarray(ratio, np.float64) ** 2
        self.maybe = np.zeros(SLOTS, bool)
        self.maybe[_mixed(self.slots)] = True

    def score(self, text: str | None) -> float:
        present = np.zeros(len(self.slots), bool)
        for some in grams(text):
            some = some[self.maybe[_mixed(some)]]
            if len(some):
                place = np.minimum(np.searchsorted(self.slots, some), len(self.slots) - 1)
                present[place[self.slots[place] == some]] = True
        length = float(self.square[present].sum()) ** 0.5
        margin = float(self.weight[present].sum()) / max(length, 1e-6)
        return float(1 / (1 + np.exp(-(margin + self.bias))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, slots: np.ndarray, ratio: np.ndarray,
        penalty: float = 0.3, steps: int = 150) -> Model:
    """A model from the features of each row, as places in ``slots``, and whether it is toxic.

    A feature's value is its ``ratio``.  Rows are scaled to length one, classes weigh the
    same, and the logistic loss with an L2 penalty is minimised by accelerated gradient
    steps.  With one class only, or none, every score is that class's smoothed share.
    A step goes through the rows ROWS at a time; of all features of all rows only the values are
    kept besides ``rows``.
    """
    n, positives = len(rows), int(toxic.sum())
    if positives in (0, n):
        share = (positives + 1) / (n + 2)
        return Model(slots[:0], ratio[:0], ratio[:0], float(np.log(share / (1 - share))))
    values = []
    for start in range(0, n, ROWS):
        owner, flat = _laid(rows[start:start + ROWS])
        length = np.sqrt(np.maximum(np.bincount(owner, ratio[flat] ** 2), 1e-12))
        values.append(ratio[flat] / length[owner])
    weigh = np.where(toxic, 0.5 / positives, 0.5 / (n - positives))
    rate = 1 / (0.5 + penalty)
    coef = ahead = np.zeros(len(slots))
    bias = ahead_bias = 0.0
    pace = 1.0
    error = np.empty(n)
    for _ in range(steps):
        slope = np.zeros(len(slots))
        for start, value in zip(range(0, n, ROWS), values):
            some = slice(start, start + ROWS)
            owner, flat = _laid(rows[some])
            margin = np.bincount(owner, ahead[flat] * value, len(rows[some])) + ahead_bias
            error[some] = weigh[some] * (1 / (1 + np.exp(-margin)) - toxic[some])
            # Added in the order of the rows, so that ROWS does not change a sum.
            np.add.at(slope, flat, error[some][owner] * value)
        slope = slope + penalty * 1e-2 * ahead
        new, new_bias = ahead - rate * slope, ahead_bias - rate * error.sum()
        following = (1 + (1 + 4 * pace ** 2) ** 0.5) / 2
        push = (pace - 1) / following
        ahead, ahead_bias = new + push * (new - coef), new_bias + push * (new_bias - bias)
        coef, bias, pace = new, new_bias, following
    return Model(slots, ratio, coef, float(bias))


def _laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows end to end: the number of each one's row, and the places."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1_500,
          max_features: int = 1 << 15) -> Model:
    """A model from documents and their ``labels(doc_id, toxic)``.

    About ``per_class`` labelled documents of each class are used, chosen by a hash of
    doc_id (all, if there are fewer): that bounds what is joined and fitted.  Of the n-grams the
    ``max_features`` are kept whose log ratio of shares in the two classes is largest
    against its standard error; only they reach the driver.  Labels that are null, ids that
    are null or labelled twice with different values and documents without a text teach
    nothing; a repeated document counts once (with its least text).
    """
    marks = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.create_map(*(
        F.lit(x) for label in (0, 1)
        for x in (label, min(1.0, per_class / max(counts.get(label, 0), 1)))))
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / F.lit(1 << 20)
    # At most about two times per_class rows, whatever the size of the tables.
    chosen = F.broadcast(marks.where(part < share[F.col("toxic")]))
    texts = (
        docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, toxic, text in zip(*(
                    batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                for i, slots in enumerate(features(text)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id], pa.int64()), pa.array([toxic], pa.int32()),
                         pa.array([i], pa.int32()), pa.array([slots], pa.list_(pa.int64()))],
                        names=["doc_id", "toxic", "part", "slots"])

    found = stash(texts.mapInArrow(
        split, "doc_id long, toxic int, part int, slots array<long>"), "toxicity")
    size = found.where("part = 0").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic, clean = size["toxic"] or 0, size["n"] - (size["toxic"] or 0)
    hit, miss = F.col("hit") + 1, F.col("n") - F.col("hit") + 1
    kept = (
        found.select("toxic", F.explode("slots").alias("slot"))
        .groupBy("slot").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"))
        .select("slot", (F.log(hit / (toxic + 2)) - F.log(miss / (clean + 2))).alias("ratio"),
                F.sqrt(1 / hit + 1 / miss).alias("error"))
        .orderBy((F.abs("ratio") / F.col("error")).desc(), "slot").limit(max_features)
        .select("slot", "ratio").toArrow().sort_by("slot")
    )
    slots, ratio = kept.column("slot").to_numpy(), kept.column("ratio").to_numpy()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("slots").flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column("slots")).to_numpy())
            rows = [np.flatnonzero(np.isin(slots, r, assume_unique=True))
                    for r in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"),
                 pa.array(rows, pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "places"])

    rows = found.mapInArrow(keep, "doc_id long, toxic int, places array<int>").toArrow()
    held, marks = _by_document(rows)
    return fit(held, marks, slots, ratio)


def _by_document(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The places and the mark of each document of ``rows(doc_id, toxic, places)``, by doc_id.

    A document's rows hold disjoint places, each row sorted ones; a single one is not copied.
    """
    flat = pc.list_flatten(rows.column("places")).to_numpy()
    sizes = pc.list_value_length(rows.column("places")).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    ids, marks = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
    held: dict[int, list] = {}
    marked: dict[int, int] = {}
    for i in np.argsort(ids, kind="stable"):
        held.setdefault(ids[i], []).append(flat[ends[i] - sizes[i]:ends[i]])
        marked[ids[i]] = marks[i]
    return ([r[0] if len(r) == 1 else np.sort(np.concatenate(r)) for r in held.values()],
            np.array([*marked.values()], float))


def rate(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` plus a score column (0 to 1, higher: likelier toxic) of each whole text.

    A null text is scored as an empty one.  The model is of a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        model = shared.value
        return lambda texts: [[model.score(t) for t in texts]]

    return append_columns(docs, f"{column} double", setup, text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row.

    Learns from labelled rows that are not held out; labels, lang, source and doc_id are
    not seen when scoring.  Repeated rows each get a row, other columns are ignored.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rate(rows, model).drop("text").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns kept."""
    column = fresh(docs, "toxicity")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return rate(docs, model, column).where(F.col(column) < threshold).drop(column)
