"""Exact nearest neighbours by cosine distance, and hashing embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Queries and vectors of one block; a pair of blocks is one group.
QUERY_BLOCK, VECTOR_BLOCK = 1_024, 16_384
# Queries scored against a batch at a time.
QUERY_SLICE = 256
# Ranking ignores noise below this many digits; ids break ties.
DIGITS = 9


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, earlier positions first among equals."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        candidates = np.flatnonzero(scores >= least)
    else:
        candidates = np.arange(len(scores))
    return candidates[np.argsort(-scores[candidates], kind="stable")][:k]


def _scored(vectors: DataFrame, query_ids: list, queries: np.ndarray, k: int) -> DataFrame:
    """Per task, the k best vectors of each query: what leaves a task is small.

    Vectors that are null, hold a null or have another length than the queries take no
    part.  The best so far are kept from batch to batch.
    """
    units = _unit(queries)
    id_type = dict(vectors.dtypes)["id"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[pa.Array, np.ndarray] | None] = [None] * len(units)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("id")
            by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            rows = _unit(_matrix(batch.column("embedding")))[by_id]
            # Queries in slices: the scores in memory stay a few megabytes.
            for at in range(0, len(units), QUERY_SLICE):
                scores = np.round(rows @ units[at:at + QUERY_SLICE].T, DIGITS)
                for q in range(scores.shape[1]):
                    order = _top(scores[:, q], k)
                    kept[at + q] = _merged(
                        kept[at + q], ids.take(pa.array(by_id[order])), scores[order, q], k)
        found = [(q, *x) for q, x in enumerate(kept) if x is not None]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(
                        [np.full(len(scores), q, np.int32) for q, _, scores in found])),
                    pa.concat_arrays([ids for _, ids, _ in found]),
                    pa.array(np.concatenate([scores for _, _, scores in found])),
                ],
                names=["q", "id", "score"],
            )

    whole = F.forall("embedding", lambda x: x.isNotNull())
    usable = vectors.filter(
        F.col("embedding").isNotNull() & whole & (F.size("embedding") == units.shape[1]))
    return usable.select("id", "embedding").mapInArrow(
        best, f"q int, id {id_type}, score double"
    )


def _merged(
    old: tuple[pa.Array, np.ndarray] | None, ids: pa.Array, scores: np.ndarray, k: int
) -> tuple[pa.Array, np.ndarray]:
    """The k best of two lists; smaller ids first among equals."""
    if old is None:
        return ids, scores
    ids, scores = pa.concat_arrays([old[0], ids]), np.concatenate([old[1], scores])
    by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
    order = by_id[_top(scores[by_id], k)]
    return ids.take(pa.array(order)), scores[order]


def find_similar(
    vectors: DataFrame,
    embedding: Sequence[float],
    language: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """The nearest vectors to one embedding; score = 1 - cosine distance."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is 1 to 50")
    if language is not None:
        vectors = vectors.filter(F.col("language") == language)
    found = _scored(vectors, [0], np.asarray([embedding], dtype=np.float64), limit)
    return found.drop("q").orderBy(F.desc("score"), "id").limit(limit)


def _block_top(k: int, schema: pa.Schema):
    """The k best vectors of each query, for one block of each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        right = right.sort_by("id")
        rows = _unit(_matrix(right["embedding"].combine_chunks()))
        units = _unit(_matrix(left["embedding"].combine_chunks()))
        asked, found, scored = [], [], []
        # Queries in slices: the scores in memory stay a few megabytes.
        for at in range(0, len(units), QUERY_SLICE):
            scores = np.round(rows @ units[at:at + QUERY_SLICE].T, DIGITS)
            for q in range(scores.shape[1]):
                order = _top(scores[:, q], k)
                asked.append(np.full(len(order), at + q))
                found.append(order)
                scored.append(scores[order, q])
        return pa.table([
            left["query_id"].take(pa.array(np.concatenate(asked))),
            right["id"].take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scored)),
        ], schema=schema)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): k nearest vectors of every query.

    Both sides are cut into blocks by hash, by length of the vectors; one task takes a block
    of queries and one of vectors and keeps the k best of each query.  Any number of queries
    is one plan, and none passes through the driver.  Vectors that are null or hold a null
    take no part; a query finds vectors of its own length.  Ids break ties.
    """
    def usable(df: DataFrame, key: str) -> DataFrame:
        whole = F.forall("embedding", lambda x: x.isNotNull())
        # New columns: both sides may come from the same rows.
        return df.where(F.col("embedding").isNotNull() & whole).select(
            F.size("embedding").alias("d"), F.col(key).alias(key),
            F.col("embedding").alias("embedding"))

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))

    asked, stored = usable(queries, "query_id"), usable(vectors, "id")
    # One row for each length of vectors.
    sizes = parts(asked, QUERY_BLOCK, "is").join(parts(stored, VECTOR_BLOCK, "js"), "d")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "d").select(
        "d", "query_id", "embedding", own("query_id", "is").alias("i"), every("js").alias("j"))
    right = stored.join(sizes, "d").select(
        F.col("d").alias("d"), "id", "embedding", own("id", "js").alias("j"), every("is").alias("i"))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    schema = StructType.fromDDL(f"query_id {kinds[0]}, id {kinds[1]}, score double")
    by = ["d", "i", "j"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(
        _block_top(k, to_arrow_schema(schema)), schema)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_vectors(similar: DataFrame, snippets: DataFrame) -> DataFrame:
    """Add the properties of the found snippets."""
    return similar.join(snippets.drop("embedding"), "id", "left")


def hashing_embeddings(
    texts: DataFrame, text: str = "text", dimension: int = 384, out: str = "embedding",
    max_chars: int | None = None,
) -> DataFrame:
    """Default offline encoder: hashed term frequencies, L2-normalised, in the JVM.

    ``max_chars`` is the encoder's input cap; None encodes whole texts.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    body = F.col(text) if max_chars is None else F.left(F.col(text), F.lit(max_chars))
    tokens = texts.withColumn("__tokens", F.split(F.lower(body), r"\W+"))
    hashed = HashingTF(
        inputCol="__tokens", outputCol="__tf", numFeatures=dimension
    ).transform(tokens)
    normal = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(hashed)
    return normal.withColumn(out, vector_to_array("__unit", "float32")).drop(
        "__tokens", "__tf", "__unit"
    )
