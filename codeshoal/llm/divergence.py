"""How the sources of a language differ: term counts by sorted token pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .spans import LETTER, LOWER, cut, slices, text_bytes, tokens

# Bytes of text whose pointers are sorted at once.
SLICE = 8 << 20
# Symbols of eight bytes that pointers are told apart by before the rest is compared as a whole.
SYMBOLS = 16
# Sources and terms that one task lays side by side as a matrix.
SIDE, TERMS = 128, 4096
SCALE, SMOOTH = 1_000_000_000, 5

PART = pa.schema([
    ("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()),
    ("docs", pa.int64()), ("n", pa.int64()),
])


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers in the order of their bytes, and the run of equal tokens that each is in.

    A multikey quicksort whose symbols are eight bytes wide: all pointers are sorted by their
    first symbol, then those that still tie, run by run, by the next.  Tokens hold no byte 0, so
    a symbol that ends in one ends its token.  Ties longer than SYMBOLS symbols are sorted by
    the whole rest.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbols = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    every = np.uint64(0xFFFFFFFFFFFFFFFF)

    def symbol(which: np.ndarray, depth: int) -> np.ndarray:
        at = starts[which] + depth
        left = np.minimum(ends[which] - at, 8).astype(np.uint64)
        return symbols[at].byteswap() & (every << (np.uint64(64) - 8 * left))

    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = symbol(np.arange(n), 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    open_ = (key & np.uint64(255)) != 0
    depth = 8
    while True:
        # Places whose token goes on after this symbol and ties with a neighbour.
        tied = open_ & (~first | np.concatenate([~first[1:], [False]]))
        tied &= ends[order] - starts[order] >= depth
        places = np.flatnonzero(tied)
        if not len(places):
            break
        which, run = order[places], np.cumsum(first)[places]
        if depth >= 8 * SYMBOLS:
            rest = [data[a:b].tobytes() for a, b in zip(starts[which] + depth, ends[which])]
            ranks = {r: i for i, r in enumerate(sorted(set(rest)))}
            key = np.array([ranks[r] for r in rest], np.uint64)
        else:
            going = ends[which] - starts[which] > depth
            key = np.zeros(len(which), np.uint64)
            key[going] = symbol(which[going], depth)
        by = np.lexsort((key, run))
        which, run, key = which[by], run[by], key[by]
        order[places] = which
        first[places[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
        open_[:] = False
        if depth >= 8 * SYMBOLS:
            break
        open_[places] = (key & np.uint64(255)) != 0
        depth += 8
    return order, np.cumsum(first) - 1


def _count(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, names: pa.RecordBatch
           ) -> pa.RecordBatch:
    """Documents and occurrences of each term in each group; ``group`` numbers the rows' groups."""
    starts, ends, row = tokens(data, offsets, LETTER)
    order, run = sort_pointers(data, starts, ends)
    rows = max(len(offsets) - 1, 1)
    # An equal run holds a term's tokens; each row in it is one document.
    code, times = np.unique(run * rows + row[order], return_counts=True)
    run_of, row_of = code // rows, code % rows
    groups = max(len(names), 1)
    code, back = np.unique(run_of * groups + group[row_of], return_inverse=True)
    docs = np.bincount(back, minlength=len(code))
    total = np.bincount(back, times, minlength=len(code)).astype(np.int64)
    heads = order[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))] if len(run) else order
    terms = cut(data, offsets, starts[heads], ends[heads])
    which = pa.array(code % groups)
    return pa.RecordBatch.from_arrays(
        [names.column(0).take(which), names.column(1).take(which),
         terms.take(pa.array(code // groups)), pa.array(docs.astype(np.int64)), pa.array(total)],
        schema=PART)


def _whole(data: np.ndarray, names: pa.RecordBatch) -> pa.RecordBatch:
    """The same for one long document, cut between terms; it counts once for each of its terms."""
    gaps = np.flatnonzero(~LETTER[data])
    found, start = [], 0
    while start < len(data):
        place = np.searchsorted(gaps, start + SLICE)
        end = int(gaps[place]) + 1 if place < len(gaps) else len(data)
        part = data[start:end]
        found.append(_count(part, np.array([0, len(part)]), np.zeros(1, np.int64), names))
        start = end
    merged = pa.Table.from_batches(found).group_by("term").aggregate([("n", "sum")])
    n = merged.num_rows
    same = pa.array(np.zeros(n, np.int64))
    return pa.RecordBatch.from_arrays(
        [names.column(0).take(same), names.column(1).take(same),
         merged["term"].combine_chunks(), pa.array(np.ones(n, np.int64)),
         merged["n_sum"].combine_chunks()], schema=PART)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        for start, end in slices(sizes, SLICE):
            part = batch.slice(start, end - start)
            data, offsets = text_bytes(part.column("text"))
            data = LOWER[data]
            keys = pa.Table.from_arrays(
                [part.column("lang").cast(pa.large_string()),
                 part.column("source").cast(pa.large_string())], ["lang", "source"])
            names = keys.group_by(["lang", "source"]).aggregate([]).combine_chunks()
            names = names.append_column("at", pa.array(np.arange(len(names))))
            names = names.to_batches()[0]
            if len(data) > SLICE:
                yield _whole(data, names)
                continue
            number = {(a, b): i for a, b, i in zip(*(c.to_pylist() for c in names.columns))}
            group = np.fromiter(
                (number[k] for k in zip(keys["lang"].to_pylist(), keys["source"].to_pylist())),
                np.int64, len(keys))
            yield _count(data, offsets, group, names)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): rows of ``docs`` that hold the term, and occurrences.

    Terms are runs of letters (ASCII ones, and any character beyond ASCII), A-Z in lower
    case.  Null text, lang and source count as empty; each row is one document, repeated ones too.
    """
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(
        _shards, "lang string, source string, term string, docs long, n long"
    ).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term in parts of SCALE, in whole numbers."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", wide, (total + SMOOTH * kept).cast("decimal(19,0)")) + 1


SHARES = "lang string, a string, b string, value long"


def _distances(table: pa.Table) -> pa.Table:
    """Summed differences between the sources of two blocks over one block of terms.

    A row without a term says how a source stands where it lacks one (``none``).  Only terms of
    the table differ from that; the first block of terms adds the rest for all terms.
    """
    lang, block, left, right = (table[c][0].as_py() for c in ("lang", "block", "left", "right"))
    seeds = table.filter(pc.is_null(table["term"]))
    names = seeds["source"].to_pylist()
    side = seeds["side"].to_numpy()
    none = seeds["none"].to_numpy()
    rest = seeds["kept"].to_numpy() * (block == 0)
    entries = table.filter(pc.is_valid(table["term"]))
    terms = entries["term"].combine_chunks().dictionary_encode()
    place = {name: i for i, name in enumerate(names)}
    row = np.fromiter((place[s] for s in entries["source"].to_pylist()), np.int64, len(entries))
    matrix = np.repeat(none[:, None], len(terms.dictionary), axis=1)
    matrix[row, terms.indices.to_numpy()] = entries["p"].to_numpy()
    width = matrix.shape[1]
    ours, theirs = np.flatnonzero(side == left), np.flatnonzero(side == right)
    a, b, value = [], [], []
    for i in ours:
        apart = np.abs(matrix[theirs] - matrix[i]).sum(axis=1, dtype=np.int64)
        apart += (rest[i] - width) * np.abs(none[theirs] - none[i])
        for j, d in zip(theirs, apart.tolist()):
            if i != j:
                a.append(names[i])
                b.append(names[j])
                value.append(d)
    if left != right:
        a, b, value = a + b, b + a, value * 2
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()),
                     "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def source_distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): how far each two sources of a language are apart over its kept terms.

    ``entries`` has (lang, source, term, p) of the terms that occur, ``groups`` (lang, source, kept,
    none) of all sources.  Terms and sources are cut into blocks; a task gets one block
    of terms for one pair of blocks of sources, so its matrices are bounded, and no
    term is joined with itself.
    """
    sized = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / SIDE).alias("sides"),
        F.greatest(F.ceil(F.max("kept") / TERMS), F.lit(1)).alias("blocks"))
    placed = groups.join(sized, "lang").withColumn(
        "side", F.pmod(F.xxhash64("source"), F.col("sides")))
    seeds = placed.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"),
        "none", "kept", "side", "sides",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    rows = entries.join(placed, ["lang", "source"]).select(
        "lang", "source", "term", "p", "none", "kept", "side", "sides",
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("other")
    spread = seeds.unionByName(rows).select("*", other).select(
        "lang", "source", "term", "p", "none", "kept", "side", "block",
        F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    return spread.groupBy("lang", "block", "left", "right").applyInArrow(
        _distances, SHARES).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs.

    A language keeps the terms that at least ``min_docs`` of its documents hold.  Each group of
    lang and source gives every kept term a share, smoothed and in whole parts of 10^9.  Part
    ``pair``: for each other source of the language, the summed differences of shares over all
    kept terms.  Part ``term``: the group's ``top`` terms by what their share exceeds that of
    the whole language.  Ties go by the item's bytes.

    Null text, lang and source count as empty, each row as one document, repeated ones
    too.  A group without kept terms has pairs only; a language that keeps none has
    pairs of value 0; the only source of a language has none.  Empty tables give no rows; other
    columns are ignored.
    """
    counts = stash(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("held"), F.sum("n").alias("all_n")).where(F.col("held") >= min_docs)
    found = stash(counts.join(kept, ["lang", "term"]).select(
        "lang", "source", "term", "n", "all_n"), "kept-terms")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = found.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("all_total"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = stash(
        groups.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").select(
            "lang", "source",
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "all_total"))
        ).withColumn("none", F.when(F.col("kept") > 0, share(
            F.lit(0), F.col("total"), F.col("kept"))).otherwise(0).cast("long")), "groups")
    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("all_n"), F.col("all_total"), F.col("kept")).alias("q"))
    pairs = source_distances(
        shares.select("lang", "source", "term", "p"), groups.select("lang", "source", "kept", "none"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    by_pair = pairs.select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"),
        "value").withColumn("rank", F.row_number().over(ranked))
    by_term = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("p") - F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return by_pair.unionByName(by_term)


ORACLE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
found AS (SELECT id, lang, source, unnest(terms) AS term FROM rows),
kept AS (
  SELECT lang, term, count(*) AS all_n FROM found GROUP BY lang, term
  HAVING count(DISTINCT id) >= 30),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
langs AS (
  SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
members AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(l.v, 0) AS v, l.all_total
  FROM (SELECT DISTINCT lang, source FROM rows) g
  LEFT JOIN totals t USING (lang, source) LEFT JOIN langs l USING (lang)),
shares AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (m.total + 5 * m.v) AS p,
         1 + (1000000000::HUGEINT * (k.all_n + 5)) // (m.all_total + 5 * m.v) AS q
  FROM members m JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM members a JOIN members b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
WHERE part = 'pair' OR rank <= 50
"""
