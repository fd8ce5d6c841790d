"""Mixing sources to target weights by systematic sampling, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix"
# Documents of one source and size are ordered through this many hash bins, so that no
# task has to number more than a bin of them.
BIN_DIGITS = 3


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP
                   ) -> DataFrame:
    """Targets of the sources in ``totals(key, source_size)``.

    Sources in the order of ``key`` weigh ``weights``, repeating, and share the sum of all
    sizes; no target exceeds ``cap`` times the source's size.  Raising one common level
    fills the sources with the least cap per weight first, so the level is read
    off running sums: it is the first one that the next source can still take.
    The windows see one row per source and nothing else.
    """
    by_name = Window.orderBy("key")
    pattern = F.array(*(F.lit(int(w)) for w in weights))
    weighed = totals.select(
        "key", "source_size",
        F.element_at(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
        .cast("long").alias("weight"),
        (F.col("source_size") * cap).alias("most"),
    )
    fill = Window.orderBy(F.col("most") / F.col("weight"), "key")
    everything = Window.partitionBy()
    filled = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
        .alias("open_weight"),
        (F.sum("most").over(fill) - F.col("most")).alias("full"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open_weight")
    fits = level * F.col("weight") <= F.col("most")
    leveled = filled.withColumn("level", F.min(F.struct(
        (~fits).alias("late"), (F.col("most") / F.col("weight")).alias("at"), "key",
        level.alias("level"))).over(everything)["level"])
    return leveled.select(
        "key", "source_size",
        F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def with_copies(docs: DataFrame, column: str, size: str, weights: Sequence[int] = WEIGHTS,
                cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus how often each is taken; names of the columns that describe its source.

    Within a source documents are ordered by falling size, a hash bin of doc_id and
    doc_id.  Each expects ``target / source_size`` copies; their running sum, shifted by one
    offset per source that depends on ``seed`` alone, gives one copy per whole number
    that it crosses.  So a source's taken words stray from its target by about its longest
    document at most, and reruns agree.  Ranks come from counts per source and size,
    then per bin, then a row number within a bin, so that no window holds a source.
    """
    key, order = fresh(docs, "mix_key"), fresh(docs, "mix_bin")
    rows = docs.withColumn(
        key, F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))
    ).withColumn(order, _hex(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), BIN_DIGITS))
    bins = rows.groupBy(
        F.col(key).alias("key"), F.col(size).alias("size"), F.col(order).alias("bin")
    ).agg(F.count("*").alias("n"))
    sizes = bins.groupBy("key", "size").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, cap)
    larger = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("key", "size").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select(
        "key", "size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("larger")
    ).join(targets, "key")
    starts = bins.select(
        "key", "size", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")
    ).join(starts, ["key", "size"])
    names = {n: fresh(rows, n) for n in ("source_size", "target")}
    start = fresh(rows, "mix_start")
    starts = starts.select(
        F.col("key").alias(key), F.col("size").alias(size), F.col("bin").alias(order),
        (F.col("larger") + F.col("earlier")).alias(start),
        F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]),
    )
    placed = rows.join(starts, [key, size, order])
    within = Window.partitionBy(key, size, order).orderBy(F.col("doc_id").asc_nulls_last())
    rank = F.col(start) + F.row_number().over(within)
    ratio = F.when(F.col(names["source_size"]) == 0, 0.0).otherwise(
        F.col(names["target"]) / F.col(names["source_size"]))
    offset = _hex(F.concat(F.lit(seed), F.col(key)), 4) / F.lit(65536.0)
    copies = F.floor(ratio * rank + offset) - F.floor(ratio * (rank - 1) + offset)
    return placed.withColumn(column, copies).drop(key, order, start), names


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED
             ) -> DataFrame:
    """(doc_id, source, copies, size, source_size, target, taken), one row per document row.

    A null or wordless text has size 0; its copies take no words.  Null sources are one
    source, the last.  Repeated rows are rows like any others.  Other columns are
    ignored; an empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    placed, names = with_copies(sized, "copies", "size", weights, cap, seed)
    return placed.select(
        "doc_id", "source", "copies", "size", F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"), (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED
        ) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan takes it, all columns kept."""
    size, copies, turn = (fresh(docs, n) for n in ("mix_size", "mix_copies", "mix_turn"))
    sized = docs.withColumn(size, word_count(F.col("text")))
    placed, _ = with_copies(sized, copies, size, weights, cap, seed)
    return (
        placed.where(F.col(copies) > 0)
        .withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        .select(*docs.columns)
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3)) AS BIGINT) AS bin,
    coalesce('+' || source, '-') AS k
  FROM documents),
totals AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS weight
  FROM sized GROUP BY k),
levels AS (
  SELECT *, (sum(source_size) OVER () - sum(3 * source_size) OVER low + 3 * source_size)
      / CAST(sum(weight) OVER () - sum(weight) OVER low + weight AS DOUBLE) AS level
  FROM totals
  WINDOW low AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), k
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chosen AS (
  SELECT level FROM levels WHERE level * weight <= 3 * source_size
  ORDER BY 3 * source_size / CAST(weight AS DOUBLE), k LIMIT 1),
targets AS (
  SELECT k, source_size,
    least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT level FROM chosen), 0) * weight) AS target,
    CAST(('0x' || substr(md5('mix' || k), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS u
  FROM levels),
ranked AS (
  SELECT doc_id, size, source_size, target, u,
    CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS ratio,
    row_number() OVER (PARTITION BY k ORDER BY size DESC, bin, doc_id NULLS LAST) AS pos
  FROM sized JOIN targets USING (k))
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(ratio * pos + u) - floor(ratio * (pos - 1) + u)) AS BIGINT) AS taken
FROM ranked
"""
