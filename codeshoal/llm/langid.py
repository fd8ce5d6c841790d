"""Language identification: known words first, shorter and shorter n-grams for the rest."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, held_out, stash

UNKNOWN = "und"


def _ranges(kinds: str, most: int) -> str:
    """Characters whose Unicode category begins with one of ``kinds``, for a pattern's brackets."""
    found = [c for c in range(most + 1) if category(chr(c))[0] in kinds]
    cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    runs = zip([0, *cuts], [*cuts, len(found)])
    return "".join(f"\\U{found[a]:08x}-\\U{found[b - 1]:08x}" for a, b in runs)


# A word is a letter with the letters and combining marks after it.  Most texts stay below
# 65,536, where a set of characters is one table look-up.
NARROW, WIDE = (
    re.compile(f"[{_ranges('L', most)}][{_ranges('LM', most)}]*") for most in (0xFFFF, sys.maxunicode))
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> Iterator[str]:
    """The words of a text in lower case."""
    text = text.lower()
    return (m.group() for m in (WIDE if BEYOND.search(text) else NARROW).finditer(text))
# Words looked up at a time in a long text.
STEP = 100_000
# Scores of words met in a task are kept up to this many.
MEMO = 200_000


class Model:
    """Log frequencies of words and of character n-grams in each language."""

    def __init__(self, languages: list[str], words: dict, grams: dict, orders: tuple[int, ...]):
        self.languages, self.orders = languages, orders
        self.words = self._logs(words)
        self.grams = {n: self._logs(grams.get(n, {})) for n in orders}

    def _logs(self, counts: dict) -> dict[str, tuple[float, ...]]:
        """Add-one smoothed log frequencies; a language without an item gets its floor."""
        if not counts:
            return {}
        totals = np.sum([c for c in counts.values()], axis=0) + len(counts)
        return {
            item: tuple(math.log((c + 1) / t) for c, t in zip(row, totals))
            for item, row in counts.items()
        }

    def word(self, word: str) -> tuple[float, ...]:
        """Scores of one lower-case word, one for each language."""
        known = self.words.get(word)
        if known:
            return known
        padded = f" {word} "
        for n in self.orders:
            table = self.grams[n]
            found = [table[g] for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) in table]
            if found:
                return tuple(sum(column) / len(found) for column in zip(*found))
        return (0.0,) * len(self.languages)


class _Memo(dict):
    """Scores of words; a word that is missing is scored and added."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> tuple[float, ...]:
        self[word] = scores = self.model.word(word)
        return scores


def scorer(model: Model):
    """Function from texts to predicted languages and scores."""
    memo = _Memo(model)

    def one(text: str | None) -> tuple[str, float]:
        nonlocal memo
        total, seen = np.zeros(len(model.languages)), False
        words = words_of(text or "")
        while part := list(islice(words, STEP)):
            seen = True
            if len(memo) > MEMO:
                memo = _Memo(model)
            counts = Counter(part)
            total += np.fromiter(counts.values(), float) @ np.array([memo[w] for w in counts])
        if not seen or not model.languages:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return model.languages[best], float(1 / np.exp(total - total[best]).sum())

    def make(texts: list) -> tuple[list, list]:
        found = [one(t) for t in texts]
        return [f[0] for f in found], [f[1] for f in found]

    return make


def _count(orders: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = Counter(chain.from_iterable(map(words_of, texts)))
                if not words:
                    continue
                yield _frame(lang, 0, words)
                for n in orders:
                    grams: Counter = Counter()
                    for word, c in words.items():
                        padded = f" {word} "
                        for i in range(len(padded) - n + 1):
                            grams[padded[i:i + n]] += c
                    if grams:
                        yield _frame(lang, n, grams)

    return run


def _frame(lang: str, n: int, counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "n": n, "item": list(counts), "c": list(counts.values())})


def train(docs: DataFrame, per_language: int = 3_000, least_share: float = 2e-5,
          orders: tuple[int, ...] = (5, 4, 3, 2, 1)) -> Model:
    """A model from rows ``(doc_id, text, lang)`` with a language and a text.

    For each language about ``per_language`` documents are used, chosen by a hash of
    doc_id (all, if there are fewer).  Kept are the words, and the n-grams of each order, that make
    up at least ``least_share`` of the language's; so there are at most ``1 / least_share``
    of each kind, whatever the input.  What is not kept backs off.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    shares = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(shares)
    if not languages:
        return Model([], {}, {}, orders)
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("langid")), F.lit(1 << 20))
    bound = F.create_map(*(
        F.lit(x) for lang in languages
        for x in (lang, min(1 << 20, -(-per_language * (1 << 20) // shares[lang])))))
    counted = stash(
        usable.where(part < bound[F.col("lang")]).select("lang", "text")
        .mapInPandas(_count(orders), "lang string, n int, item string, c long")
        .groupBy("lang", "n", "item").agg(F.sum("c").alias("c")), "langid")
    # One row for each language and order.
    totals = F.broadcast(counted.groupBy("lang", "n").agg(F.sum("c").alias("total")))
    kept = counted.join(totals, ["lang", "n"]).where(F.col("c") >= F.col("total") * least_share)
    place = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict] = {}
    for row in kept.select("lang", "n", "item", "c").toPandas().itertuples(index=False):
        counts = tables.setdefault(row.n, {}).setdefault(row.item, [0] * len(languages))
        counts[place[row.lang]] = row.c
    return Model(languages, tables.pop(0, {}), tables, orders)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (the share of the best language's likelihood).

    A text that is null or has no letter, or a model without languages, gives ``und``
    and score 0.  Texts are scored whole, a part at a time.  Ties go to the language
    that sorts first.  The model is bounded, see ``train``, and goes to the tasks once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, "lang_pred string, score double",
                          lambda: scorer(shared.value), text)


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document row.

    Learns from the rows that are not held out; lang, source and doc_id are not seen when
    predicting.  Repeated rows count as often as they occur, other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).drop("text")
