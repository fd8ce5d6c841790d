"""SimHash fingerprints and near-duplicate classes by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, fresh, stash
from .components import components

BITS = 64
# Shingles hashed at a time, so that a very long text needs little memory.
STEP = 16_384
# Fingerprints compared in one go; larger blocks are cut into pairs of such pieces.
PIECE = 1_024


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text (unsigned)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    votes, total = np.zeros(BITS, np.int64), len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, STEP):
        part = words[start:start + STEP + width - 1]
        grams = zip(*(part[i:] for i in range(width)))
        hashes = np.array([digest(b" ".join(g), seed) for g in grams], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(votes * 2 > total, bitorder="little")
    return int(chosen.view("<u8")[0])


def with_fingerprint(docs: DataFrame, column: str, text: str = "text", shingle: int = 3,
                     seed: int = 42) -> DataFrame:
    """``docs`` plus its fingerprints as a signed long column."""
    def setup():
        return lambda texts: [np.array(
            [fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)]

    return append_columns(docs, f"{column} long", setup, text)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of which every two fingerprints within ``distance`` share at least one.

    The bits are cut into ``blocks`` blocks; differing bits touch at most
    ``distance`` of them, so some ``blocks - distance`` blocks are equal.
    """
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def near_edges(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the values that are within ``distance``, not all pairs."""
    rest = np.unique(values)
    edges = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= distance
            hit = rest[near]
            edges.extend((int(root), int(x)) for x in hit)
            frontier.extend(hit)
            rest = rest[~near]
    return edges


def near_fingerprints(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b): edges that connect the distinct longs ``prints.fp`` within ``distance``.

    Each fingerprint is keyed by every choice of blocks.  Keys held by one alone
    drop out.  A key held by many is cut into pieces by hash and every two pieces
    meet in a task of their own, so a task compares at most about two pieces
    and all pairs are still compared.  What leaves a task is a spanning forest.
    """
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in block_masks(blocks, distance)]
    keyed = prints.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)
    ))).alias("k")).select("fp", "k.mask", "k.key")
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / PIECE)
    own = F.pmod(F.xxhash64("fp"), pieces)
    met = (
        keyed.join(shared, ["mask", "key"])
        .withColumn("pieces", pieces)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .select("mask", "key", F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"), "fp")
        .groupBy("mask", "key", "i", "j")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [
                edge for fps in batch["fps"]
                for edge in near_edges(np.asarray(fps, np.int64).view(np.uint64), distance)
            ]
            flat = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": flat[:, 0], "b": flat[:, 1]})

    return met.mapInPandas(link, "a long, b long").distinct()


def near_classes(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, root) for fingerprints that have a near one; ``root`` names the class."""
    return components(near_fingerprints(prints, distance, blocks), "simhash").select(
        F.col("node").alias("fp"), F.col("component").alias("root"))


def simhash_classes(docs: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row.

    A null text counts as empty; texts without words have fingerprint zero and link
    like any others.  Equal fingerprints form one node, so copies cost a row each and no
    pairs.  ``component_id`` is the least non-null doc_id of the class (null if there
    is none).  Repeated rows each get a row; other columns are ignored; an empty table
    gives no rows.
    """
    marked = stash(with_fingerprint(docs.select("doc_id", "text"), "fp").drop("text"), "simhash")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = near_classes(prints.select("fp"), distance, blocks)
    linked = prints.join(classes, "fp")
    firsts = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(firsts, "root").select("fp", "least")
    return (
        marked.join(prints, "fp")
        .join(named, "fp", "left")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.coalesce("least", "first").alias("component_id"),
        )
    )


def simhash_dedup(docs: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """One document of each class: the one with the least doc_id (nulls last).

    All columns of ``docs`` are kept.  Of repeated rows one is kept.
    """
    column = fresh(docs, "fp")
    marked = stash(with_fingerprint(docs.select("doc_id", "text"), "fp").drop("text"), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    prints = marked.groupBy("fp").agg(F.min(rank).alias("best"))
    classes = near_classes(prints.select("fp"), distance, blocks)
    best = (
        prints.join(classes, "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.doc_id").alias("keep_id"), F.col("best.fp").alias("keep_fp"))
    )
    full = with_fingerprint(docs, column)
    key = fresh(full, "keep")
    full = full.withColumn(key, _row_key(F.col(column), F.col("doc_id")))
    best = best.select(_row_key(F.col("keep_fp"), F.col("keep_id")).alias(key))
    return full.join(best, key).dropDuplicates([key]).select(*docs.columns)


def _row_key(fp: Column, doc_id: Column) -> Column:
    return F.concat_ws("/", fp.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("none")))
