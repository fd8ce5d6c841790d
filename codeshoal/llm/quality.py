"""Quality rules as a cascade: rules that reject much for little time come first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spans import BLANK, slices, strings, text_bytes, tokens

# Bytes of text that are looked at together.
SLICE = 4 << 20
# The sample: at most so many rows and bytes of each split, and so many splits, evenly spaced.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SPLITS = 100, 1 << 20, 200
WINDOW = 8


def _members(characters: bytes) -> np.ndarray:
    member = np.zeros(256, bool)
    member[list(characters)] = True
    return member


SYMBOL = _members(b"#*$%&|<>")
UPPER = _members(bytes(range(0x41, 0x5B)))
ASCII_LETTER = UPPER | _members(bytes(range(0x61, 0x7B)))
LETTER = ASCII_LETTER | (np.arange(256) >= 0x80)
# A line that begins with one of these marks is a list item, one that ends with these is cut off.
BULLETS, CUT_OFF = ("-", "*", "•", "‣", "●"), ("...", "…")


class Texts:
    """Texts end to end, with what the rules ask about them, each worked out once at most."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def only(self, rows: np.ndarray) -> Texts:
        """The texts of some rows."""
        if len(rows) == len(self):
            return self
        starts, ends = self.offsets[rows], self.offsets[rows + 1]
        parts = [self.data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        kept = Texts(np.concatenate([self.data[:0], *parts]),
                     np.concatenate([[0], np.cumsum(ends - starts)]))
        kept.__dict__.update({name: self.__dict__[name][rows] for name in COUNTS if name in self.__dict__})
        return kept

    def count(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tokens(self.data, self.offsets, ~BLANK)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=len(self))

    @cached_property
    def word_chars(self) -> np.ndarray:
        # A character begins at each byte that does not continue one.
        return self.count(~BLANK[self.data] & ((self.data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(SYMBOL[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each line that holds a word."""
        breaks = np.flatnonzero(self.data == 0x0A)
        counts = self.count(self.data == 0x0A) + 1
        row = np.repeat(np.arange(len(self)), counts)
        last = np.zeros(len(row), bool)
        last[np.cumsum(counts) - 1] = True
        first = np.roll(last, 1)
        starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        starts[first], starts[~first] = self.offsets[:-1], breaks + 1
        ends[last], ends[~last] = self.offsets[1:], breaks
        begun = self.words[0]
        held = np.searchsorted(begun, starts) < np.searchsorted(begun, ends)
        return starts[held], ends[held], row[held]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=len(self))

    @cached_property
    def line_texts(self) -> pa.Array:
        starts, ends, _ = self.lines
        marks = np.zeros(len(self.data) + 1, np.int8)
        marks[starts] = 1
        marks[ends] -= 1
        inside = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
        return strings(self.data[inside], np.concatenate([[0], np.cumsum(ends - starts)]))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        row = self.lines[2]
        same = _numbers(self.line_texts)
        distinct = np.unique(row * (len(same) + 1) + same) // (len(same) + 1)
        return self.n_lines - np.bincount(distinct, minlength=len(self))

    @cached_property
    def names(self) -> np.ndarray:
        """A number for each word, equal words alike."""
        starts, ends, _ = self.words
        return _numbers(strings(
            self.data[~BLANK[self.data]], np.concatenate([[0], np.cumsum(ends - starts)])))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of WINDOW words that the same text holds twice or more.

        Windows are named exactly: names of two halves together name the whole, at 2, 4 and 8 words.
        """
        row, name = self.words[2], self.names
        n = len(row) - WINDOW + 1
        if n <= 0:
            return np.zeros(len(self), np.int64)
        width = 1
        while width < WINDOW:
            name = _numbers(pa.array(name[:-width] * (len(name) + 1) + name[width:]))
            width *= 2
        whole = row[:n] == row[WINDOW - 1:]
        places = np.flatnonzero(whole)
        name = _numbers(pa.array(row[places] * (len(name) + 1) + name[places]))
        often = places[(np.bincount(name) >= 2)[name]] if len(places) else places
        marks = np.bincount(often, minlength=len(row) + 1)
        marks -= np.bincount(often + WINDOW, minlength=len(row) + 1)
        return np.bincount(row, np.cumsum(marks[:-1]) > 0, minlength=len(self)).astype(np.int64)

    @cached_property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def lines_that(self, matches: pa.Array) -> np.ndarray:
        """How many of each text's lines match."""
        return np.bincount(
            self.lines[2], matches.to_numpy(zero_copy_only=False), minlength=len(self))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "base_failed")


def _numbers(values: pa.Array) -> np.ndarray:
    """Equal values as equal small numbers."""
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def _any(texts: pa.Array, test: Callable, marks: tuple[str, ...]) -> pa.Array:
    found = test(texts, marks[0])
    for mark in marks[1:]:
        found = pc.or_(found, test(texts, mark))
    return found


class Rule(NamedTuple):
    """``rejects`` gives a truth value for each of some texts."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 3 * t.n_words) | (t.word_chars > 12 * t.n_words)


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def _repeated_lines(t: Texts) -> np.ndarray:
    return 2 * t.n_dup_lines > t.n_lines


def _stammer(t: Texts) -> np.ndarray:
    row, name = t.words[2], t.names
    same = (row[1:] == row[:-1]) & (name[1:] == name[:-1])
    return 10 * np.bincount(row[1:], same, minlength=len(t)) > 3 * t.n_words


def _without_letters(t: Texts) -> np.ndarray:
    starts, ends, row = t.words
    sums = np.concatenate([[0], np.cumsum(LETTER[t.data], dtype=np.int64)])
    lettered = np.bincount(row, sums[ends] > sums[starts], minlength=len(t))
    return 10 * lettered < 8 * t.n_words


def _capitals(t: Texts) -> np.ndarray:
    return 100 * t.count(UPPER[t.data]) > 30 * t.count(ASCII_LETTER[t.data])


def _list_items(t: Texts) -> np.ndarray:
    trimmed = pc.ascii_ltrim_whitespace(t.line_texts)
    return 10 * t.lines_that(_any(trimmed, pc.starts_with, BULLETS)) > 9 * t.n_lines


def _cut_off(t: Texts) -> np.ndarray:
    trimmed = pc.ascii_rtrim_whitespace(t.line_texts)
    return 10 * t.lines_that(_any(trimmed, pc.ends_with, CUT_OFF)) > 3 * t.n_lines


RULES = (
    Rule("word_length", _word_length), Rule("symbols", _symbols),
    Rule("repeated_lines", _repeated_lines), Rule("stammer", _stammer),
    Rule("without_letters", _without_letters), Rule("capitals", _capitals),
    Rule("list_items", _list_items), Rule("cut_off", _cut_off),
)


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The number of the first rule that rejects each text (-1: none does).

    A rule sees only the texts that no rule before it has rejected.
    """
    by = np.full(len(texts), -1)
    alive = np.arange(len(texts))
    for number, rule in enumerate(rules):
        if not len(alive):
            break
        rejected = rule.rejects(texts)
        by[alive[rejected]] = number
        alive, texts = alive[~rejected], texts.only(np.flatnonzero(~rejected))
    return by


def best_order(masks: dict[int, int], seconds: list[float]) -> list[int]:
    """Rules by what they reject per cost among the texts that the rules before them pass.

    ``masks`` counts sampled texts by the set of rules (as bits) that reject them.  Rules that
    reject nothing more come last, cheap ones first.
    """
    left, order = dict(masks), []
    while len(order) < len(seconds):
        rest = [r for r in range(len(seconds)) if r not in order]
        rejected = {r: sum(n for m, n in left.items() if m >> r & 1) for r in rest}
        best = max(rest, key=lambda r: (rejected[r] / max(seconds[r], 1e-9), -seconds[r], -r))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text"
                 ) -> tuple[Rule, ...]:
    """``rules`` in the order that a sample speaks for.

    The sample are the first rows of evenly spaced splits of ``docs``: at most SAMPLE_ROWS rows and
    about SAMPLE_BYTES bytes of each of about SAMPLE_SPLITS splits, read no further.  Each task takes the time of
    every rule on its rows; the driver gets sums, at most one row for each set of rules.
    The order changes what the cascade costs, never which texts it keeps.
    """
    sampled = docs.select(F.col(text).alias("text"))
    stride = max(1, sampled.rdd.getNumPartitions() // SAMPLE_SPLITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % stride:
            return
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy()
            rows = max(1, int(np.searchsorted(np.cumsum(sizes), SAMPLE_BYTES)))
            texts = Texts(*text_bytes(batch.column(0).slice(0, min(rows, SAMPLE_ROWS))))
            passed = np.flatnonzero(~texts.base_failed)
            mask, took = np.zeros(len(passed), np.int64), []
            for bit, rule in enumerate(rules):
                own = Texts(*_bytes_of(texts.only(passed)))
                own.__dict__.update({name: texts.__dict__[name][passed]
                                     for name in COUNTS if name in texts.__dict__})
                began = time.thread_time()
                mask |= rule.rejects(own).astype(np.int64) << bit
                took.append(time.thread_time() - began)
            kinds, n = np.unique(mask, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*kinds.tolist(), -1]), pa.array([*n.tolist(), 0]),
                 pa.array([[0.0] * len(rules)] * len(kinds) + [took], pa.list_(pa.float64()))],
                names=["mask", "n", "seconds"])
            return

    found = sampled.mapInArrow(run, "mask long, n long, seconds array<double>").groupBy("mask").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules)))).collect()
    masks = {r["mask"]: r["n"] for r in found if r["mask"] >= 0}
    seconds = [sum(r[f"s{i}"] for r in found) for i in range(len(rules))]
    return tuple(rules[r] for r in best_order(masks, seconds))


def _bytes_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return texts.data, texts.offsets


VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, rejected_by string")


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text"
                     ) -> DataFrame:
    """``docs`` with its texts replaced by their counts and verdicts (VERDICT), one row each.

    A text that the base rules fail (fewer than 20 words, or over 30 percent of them in repeated
    windows of 8) is not kept; the others pass through the cascade of ``rules`` (None: RULES in
    the order that a sample speaks for).  ``rejected_by`` names the rule that rejected: ``base``, or
    the first of the cascade in its order; null for texts kept.

    Null and empty texts have no words and fail.  Repeated rows each get a row.  Columns of ``docs``
    that are named like those of VERDICT give way to them; an empty table gives no rows.
    """
    rules = rules if rules is not None else plan_cascade(docs, text=text)
    fields = StructType.fromDDL(VERDICT).fields
    new = {f.name for f in fields}
    rest = [c for c in docs.columns if c.lower() not in new and c != text]
    source = docs.select(*rest, F.col(text).alias("text"))
    names = ["base", *(r.name for r in rules)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(rest))), 0).to_numpy()
            for start, end in slices(sizes.astype(np.int64), SLICE):
                part = batch.slice(start, end - start)
                texts = Texts(*text_bytes(part.column(len(rest))))
                counts = [getattr(texts, name) for name in COUNTS[:5]]
                passed = np.flatnonzero(~texts.base_failed)
                by = np.zeros(len(texts), np.int64)
                by[passed] = cascade(texts.only(passed), rules) + 1
                kept = np.zeros(len(texts), bool)
                kept[passed] = by[passed] == 0
                made = [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(texts.base_failed),
                        pa.array(kept), pa.array([names[b] for b in by], pa.string(), mask=kept)]
                yield pa.RecordBatch.from_arrays(
                    part.columns[:len(rest)] + made, names=rest + [f.name for f in fields])

    schema = StructType(source.schema.fields[:len(rest)] + fields)
    return source.mapInArrow(run, schema)


ORACLE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10))
            IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
windows AS (
  SELECT id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM rows)),
twice AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, w) > 1),
covered AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM twice)
  GROUP BY id),
counts AS (
  SELECT doc_id, text, words, lines, len(words) AS n_words,
         coalesce(list_sum([length(w) FOR w IN words]), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM rows LEFT JOIN covered USING (id)),
base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       base_failed,
       NOT (base_failed
         OR word_chars < 3 * n_words OR word_chars > 12 * n_words
         OR 10 * n_symbols > n_words
         OR 2 * n_dup_lines > len(lines)
         OR 10 * len([i FOR i IN range(1, len(words)) IF words[i] = words[i + 1]]) > 3 * n_words
         OR 10 * len([w FOR w IN words
                        IF regexp_matches(w, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')]) < 8 * n_words
         OR 100 * len(regexp_extract_all(text, '[A-Z]'))
            > 30 * len(regexp_extract_all(text, '[A-Za-z]'))
         OR 10 * len([x FOR x IN lines IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣●]')])
            > 9 * len(lines)
         OR 10 * len([x FOR x IN lines
                        IF regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')]) > 3 * len(lines)
       ) AS kept
FROM base
"""
