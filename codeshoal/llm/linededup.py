"""Line dedup: exact and fuzzy lines by MinHash, one line kept of each class."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from .common import fresh, stash
from .components import components

# Characters of a shingle; shorter lines are one shingle.
SHINGLE = 9
SIMILARITY = 0.8
# Lines of similarity 0.8 meet in a band with probability 0.98, of 0.85 with 0.997.
BANDS, ROWS = 10, 5
BINS = BANDS * ROWS
# Characters of line text hashed at a time, lines remembered by a task, and lines compared
# in one go (larger buckets are cut into pairs of such pieces).
STEP, SEEN, PIECE = 1 << 21, 1 << 20, 512
# Lines compared set by set at most, and shingles whose bits are compared at a time.
FEW, WIDE = 12, 1 << 14
# Rows of two longs that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
BLANK = " \t\r\x0b\x0c\x85\xa0  　"
EMPTY = np.uint32(0xFFFFFFFF)


def _scramble(values: np.ndarray, factor: int) -> np.ndarray:
    """Mix unsigned 32-bit values."""
    values = (values ^ (values >> np.uint32(15))) * np.uint32(factor)
    values ^= values >> np.uint32(13)
    return values


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE characters from each place on, from hashes of halves."""
    base = 0x01000193
    two = codes[:-1] * np.uint32(base) + codes[1:]
    four = two[:-2] * np.uint32(pow(base, 2, 1 << 32)) + two[2:]
    eight = four[:-4] * np.uint32(pow(base, 4, 1 << 32)) + four[4:]
    nine = eight[:-1] * np.uint32(base) + codes[8:]
    return _scramble(nine, 0x2C1B3C6D)


def minhashes(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash signatures, lines x BINS.

    Each shingle falls into one bin by its hash and a bin keeps its least value.  An empty
    bin borrows from the first filled one on a fixed walk of its own, the same for all
    lines, so bins of two lines agree as often as the lines are similar.
    """
    found = np.full((len(lines), BINS), EMPTY, np.uint32)
    start = 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size + len(lines[end]) <= STEP):
            size += len(lines[end]) + SHINGLE
            end += 1
        _fill(found[start:end], lines[start:end])
        start = end
    row, column = np.nonzero(found == EMPTY)
    filled, turn = found.copy(), 0
    while len(row):
        turn += 1
        walk = _scramble(np.arange(BINS, dtype=np.uint32) + np.uint32(turn * 7919), 0x297A2D39)
        value = found[row, (walk % np.uint32(BINS))[column]]
        got = value != EMPTY
        filled[row[got], column[got]] = value[got] + np.uint32(turn)
        row, column = row[~got], column[~got]
    return filled


def _fill(found: np.ndarray, lines: list[str]) -> None:
    """Least value of each line and bin; lines are laid end to end, padded to a shingle."""
    padded = [line.ljust(SHINGLE, "\0") for line in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(p) for p in padded])
    hashes = shingle_hashes(codes)
    bins = ((hashes >> np.uint32(16)) * np.uint32(BINS)) >> np.uint32(16)
    values = _scramble(hashes, 0x7FEB352D)
    across = np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)
    values[across.ravel()] = EMPTY
    slots = np.repeat(np.arange(len(lines), dtype=np.int64) * BINS, lengths)[:len(hashes)]
    slots += bins
    np.minimum.at(found.reshape(-1), slots, np.minimum(values, EMPTY))


def band_hashes(lines: list[str]) -> np.ndarray:
    """Signed 64-bit hash of each line's bands, lines x BANDS."""
    filled = minhashes(lines).astype(np.uint64).reshape(-1, BANDS, ROWS)
    banded = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), filled.shape[:2]).copy()
    for i in range(ROWS):
        banded = (banded ^ filled[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        banded ^= banded >> np.uint64(29)
    return banded.view(np.int64)


def shingles(line: str) -> frozenset:
    if len(line) <= SHINGLE:
        return frozenset((line,))
    return frozenset(line[i:i + SHINGLE] for i in range(len(line) - SHINGLE + 1))


def similar(a: frozenset, b: frozenset, least: float) -> bool:
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def shared_counts(sets: list[frozenset]) -> tuple[np.ndarray, np.ndarray]:
    """Size of each set, and how many members each has in common with each earlier one.

    Members that two sets have at least become bits, WIDE of them at a time.
    """
    numbers: dict = {}
    flat = np.array([numbers.setdefault(x, len(numbers)) for s in sets for x in s])
    sizes = np.array([len(s) for s in sets])
    shared = np.bincount(flat) > 1
    kept = shared[flat]
    row = np.repeat(np.arange(len(sets)), sizes)[kept]
    column = (np.cumsum(shared) - 1)[flat[kept]]
    order = np.argsort(column)
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(shared.sum()), WIDE):
        low, high = np.searchsorted(column, (start, start + WIDE))
        width = min(WIDE, int(column[high - 1]) + 1 - start)
        marks = np.zeros((len(sets), -(-width // 64) * 64), bool)
        marks[row[low:high], column[low:high] - start] = True
        bits = np.packbits(marks, axis=1).view(np.uint64)
        for i in range(1, len(sets)):
            both[i, :i] += np.bitwise_count(bits[:i] & bits[i]).sum(axis=1, dtype=np.int64)
    return sizes, both


def line_links(items: list[tuple[bytes, str]], least: float) -> list[tuple[bytes, bytes]]:
    """Links that connect the similar ones of ``(key, line)``: each line to its class's first.

    Exact, as every two lines are compared by all their shingles; counting bits pays
    for more than FEW lines.
    """
    sets = [shingles(line) for _, line in items]
    if len(sets) <= FEW:
        near = ([j for j in range(i) if similar(own, sets[j], least)] for i, own in enumerate(sets))
    else:
        sizes, both = shared_counts(sets)
        near = (np.flatnonzero(row[:i] >= least * (sizes[i] + sizes[:i] - row[:i])).tolist()
                for i, row in enumerate(both))
    classes = list(range(len(sets)))
    for i, found in enumerate(near):
        met = {classes[j] for j in found}
        if met:
            classes[i] = min(met)
        if len(met) > 1:
            classes = [classes[i] if c in met else c for c in classes]
    return [(items[c][0], items[i][0]) for i, c in enumerate(classes) if c != i]


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, route), a row per line that is not blank.

    Lines are cut at \\n and stripped.  ``route`` is a hash that finds candidates; what a line is
    rests on the line or its md5.
    """
    line = F.col("line")
    padded = F.lit(False)
    for char in BLANK:
        padded = padded | line.startswith(char) | line.endswith(char)
    return (
        docs.where("text IS NOT NULL")
        # Before the lines are spread, so that it is done once for a text.
        .select("doc_id", F.unhex(F.md5("text")).alias("text_key"),
                F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line"))
        .withColumn("line", F.when(padded, F.btrim("line", F.lit(BLANK))).otherwise(line))
        .where("line <> ''")
        .withColumn("route", F.xxhash64("line"))
    )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        if len(seen) > SEEN:
            seen = set()
        new = {}
        for route, line in zip(batch.column("route").to_pylist(), batch.column("line").to_pylist()):
            if route not in seen:
                new[route] = line
        seen.update(new)
        hashes = band_hashes(list(new.values())) if new else np.zeros((0, BANDS), np.int64)
        offsets = np.arange(len(new) + 1, dtype=np.int32) * BANDS
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(new), pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel()))],
            names=["route", "bands"])


def _join_checked(large: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Join; ``small`` is broadcast only if it was counted and is small."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return large.join(small, on)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist()
                                 for c in ("band", "i", "j", "line_key", "line")))

        def frame(links: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[side] for x in links], pa.binary()) for side in (0, 1)],
                names=["a", "b"])

        links: list = []
        for _, group in groupby(rows(), key=lambda r: r[:3]):
            links.extend(line_links([r[3:] for r in group], least))
            if len(links) > 10_000:
                yield frame(links)
                links = []
        yield frame(links)

    return run


def similar_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): md5 keys of similar lines, enough links to connect each class.

    Band hashes of each line are stored once.  A band hash that two different lines
    share makes a bucket; buckets of the same lines are taken once.  A bucket of many
    lines is cut into pieces by hash, and every two pieces meet in a task of their own.
    Only lines in a bucket bring their text, and exact Jaccard similarity decides.
    """
    lines = line_rows(docs)
    banded = stash(
        lines.select("route", "line").mapInArrow(_bands, "route long, bands array<long>"), "bands")
    keyed = banded.select("route", F.explode("bands").alias("band"))
    buckets = (
        keyed.groupBy("band")
        .agg(F.min("route").alias("lo"), F.max("route").alias("hi"), F.count("*").alias("n"),
             F.sum(F.shiftright("route", 20)).alias("total"))
        .where("lo < hi")
        .groupBy("lo", "hi", "n", "total").agg(F.min("band").alias("band"))
        .select("band", F.ceil(F.col("n") / PIECE).alias("pieces"))
    )
    buckets = stash(buckets, "buckets")
    members = stash(_join_checked(keyed, buckets, "band").distinct(), "members")
    wanted = members.select("route").distinct()
    texts = stash(
        _join_checked(lines.select("route", "line"), wanted, "route")
        .groupBy("route", F.unhex(F.md5("line")).alias("line_key"))
        .agg(F.min("line").alias("line")),
        "lines")
    own = F.pmod(F.xxhash64("line_key"), F.col("pieces"))
    met = (
        members.join(texts, "route")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                "line_key", "line")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        met.repartition(parts, "band", "i", "j")
        .sortWithinPartitions("band", "i", "j", "line_key")
        .mapInArrow(_verify(least), "a binary, b binary")
    )


def _place(docs_id: Column) -> Column:
    return F.struct(docs_id.isNull().alias("none"), docs_id.alias("doc_id"), "text_key", "line_no")


def removed_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, removed): numbers of the lines that a document loses.

    A class of similar or equal lines keeps the line that comes first by doc_id (null
    last), text and line number.
    """
    classes = components(similar_lines(docs, least), "lines").select(
        F.col("node").alias("line_key"), F.col("component").alias("root"))
    classes = stash(classes, "line-classes")
    occurrences = line_rows(docs).select(
        "doc_id", "text_key", "line_no", F.unhex(F.md5("line")).alias("line_key"))
    first = occurrences.groupBy("line_key").agg(
        F.min(_place(F.col("doc_id"))).alias("first"), F.count("*").alias("n"))
    rooted = first.join(classes, "line_key", "left").where("n > 1 OR root IS NOT NULL")
    rooted = stash(rooted.withColumn("root", F.coalesce("root", "line_key")), "repeated")
    best = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    kept = rooted.join(best, "root").select("line_key", "kept")
    return (
        occurrences.join(kept, "line_key")
        .where(~_place(F.col("doc_id")).eqNullSafe(F.col("kept")))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line_no").alias("removed"))
    )


def dedup_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with each class of similar lines kept once in the whole table.

    Lines are compared without white space at their ends; two are similar if they are
    equal or the Jaccard similarity of their 9-character shingles is at least ``least``, and
    classes are connected by similar lines.  Blank lines stay.  Rows are never dropped: a
    text whose lines all go becomes empty, a null text stays null.  Repeated rows (same
    doc_id and text) are one document given more than once and stay equal.
    All columns are kept; n_chars, if there, follows the new text.
    """
    lost = removed_lines(docs, least)
    key, gone, who = (fresh(docs, n) for n in ("text_key", "removed", "lost_id"))
    lost = lost.select(
        F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
                    F.hex("text_key")).alias(key), F.col("removed").alias(gone))
    keyed = docs.withColumn(key, F.concat_ws(
        "/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
        F.upper(F.md5(F.coalesce("text", F.lit(""))))))
    joined = keyed.join(lost, key, "left")
    # array_except hashes the numbers, so a text of many lines stays linear.
    left = let(F.split("text", "\n", -1), lambda parts: F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)),
            lambda i: F.get(parts, i)), "\n"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    result = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars"))
                                   .otherwise(F.length("text").cast("long")))
    return result.select(*docs.columns)
