"""Document fingerprints: quartile digests of hashed byte triplets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
# Distances of a triplet's second and third byte from its first.  Wide ones spread a language's
# common letters over more buckets, so that counts tell documents apart.
TRIPLETS = ((1, 2), (5, 11), (7, 16))
STEP = 1 << 20
# The mean difference of two unrelated buckets' codes is 1.25; more than that tells nothing.
UNRELATED = 1.25 * BUCKETS
LENGTH_STEP = 4


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of ``data`` fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    reach = max(max(t) for t in TRIPLETS)
    for start in range(0, len(data), STEP):
        part = np.frombuffer(data, np.uint8, min(STEP + reach, len(data) - start), start)
        part = part.astype(np.uint32)
        for salt, (second, third) in enumerate(TRIPLETS):
            n = min(STEP, len(part) - third)
            if n <= 0:
                continue
            mixed = part[:n] | (part[second:second + n] << 8) | (part[third:third + n] << 16)
            mixed += np.uint32(salt << 24)
            mixed *= np.uint32(2654435761)
            mixed ^= mixed >> 15
            mixed *= np.uint32(2246822519)
            mixed >>= 24
            counts += np.bincount(mixed, minlength=BUCKETS)
    return counts


def length_code(n_bytes: int) -> int:
    """The length on a scale of powers of 2 ** (1 / 8), 0 to 255."""
    return min(255, round(8 * float(np.log2(n_bytes + 1))))


def fingerprint(data: bytes) -> str:
    """Hex digest: one byte for the length, then two bits for each bucket's quartile."""
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    codes = np.zeros(BUCKETS, np.uint8)
    for quarter in (1, 2, 3):
        codes += counts > ranked[BUCKETS * quarter // 4 - 1]
    packed = codes[0::4] | (codes[1::4] << 2) | (codes[2::4] << 4) | (codes[3::4] << 6)
    return f"{length_code(len(data)):02x}" + packed.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, down to 0 for those that differ like unrelated ones."""
    if a == b:
        return 1.0
    left, right = (_codes(x) for x in (a, b))
    far = int(np.abs(left - right).sum())
    far += min(abs(int(a[:2], 16) - int(b[:2], 16)), 255) * LENGTH_STEP
    return max(0.0, 1.0 - far / UNRELATED)


def _codes(digest: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    return ((packed[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).astype(np.int16).ravel()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the head of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _slots(docs: DataFrame, parts: int) -> tuple[Column, list]:
    """A slot number that falls with doc_id, from quantiles of the ids (null: the last)."""
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.001)
    bounds = sorted({int(b) for b in bounds or []}, reverse=True)
    listed = F.array(*(F.lit(b).cast("long") for b in bounds))
    above = F.size(F.filter(listed, lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    return F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(above), bounds


def edit_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's head.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  The next document has the next smaller doc_id (equal ids by text, null ids
    last); after the last comes the first.  A null text counts as empty, repeated rows
    follow one another, a table of one row follows itself, other columns are ignored.

    The rows are dealt once, by ranges of doc_id, and read in order.  The first row
    of each range also goes to the range before it (that of the first range to
    the last), marked as a guest that only serves as the next document there.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slot, bounds = _slots(docs.select("doc_id"), parts)
    # One row per slot that has rows: at most `parts` rows, whatever the input.
    heads = docs.groupBy(slot.alias("slot")).agg(F.max("doc_id").alias("head")).collect()
    used = sorted(r["slot"] for r in heads)
    head_of = {r["slot"]: r["head"] for r in heads}
    before = {s: used[i - 1] for i, s in enumerate(used)}
    guests = F.array(*(
        F.struct(F.lit(head_of[s]).cast("long").alias("id"), F.lit(before[s]).alias("to"))
        for s in used
    )) if used else F.array().cast("array<struct<id:bigint,to:int>>")
    placed = base.withColumn("slot", slot.cast("int")).select(
        "doc_id", "text", F.explode(F.concat(
            F.array(F.struct(F.col("slot").alias("slot"), F.lit(False).alias("guest"))),
            F.transform(
                F.filter(guests, lambda g: g["id"].eqNullSafe(F.col("doc_id"))),
                lambda g: F.struct(g["to"].cast("int").alias("slot"),
                                   F.lit(True).alias("guest"))),
        )).alias("p")).select("doc_id", "text", "p.slot", "p.guest")
    ordered = placed.repartition(parts, "slot").sortWithinPartitions(
        "slot", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_compare, ROW)


ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
       "edited_fingerprint string, near_edited double, near_next double")
ARROW_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, done = None, False
    for batch in batches:
        rows = []
        ids, texts, slots, guests = (
            batch.column(c).to_pylist() for c in ("doc_id", "text", "slot", "guest"))
        for doc_id, text, slot, guest in zip(ids, texts, slots, guests):
            if guest and done:
                continue
            digest = fingerprint(text.encode())
            if held is not None and held[2] == slot:
                rows.append(_row(held, text, digest))
            done = guest
            held = None if guest else (doc_id, text, slot, digest)
        columns = zip(*rows) if rows else [[] for _ in ARROW_ROW]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, ARROW_ROW)], schema=ARROW_ROW)


def _row(held: tuple, following: str, next_digest: str) -> tuple:
    doc_id, text, _, digest = held
    changed = edited(text, following).encode()
    own = fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), digest, own,
            likeness(digest, own), likeness(digest, next_digest))
