"""Corpus preparation: weighting, shuffling, splitting, formatting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

SEED = 42
# Digits of the hash read per selection level: 16**3 = 4096 counters.
RADIX_DIGITS = 3


def order_key(key: Column, seed: int = SEED) -> Column:
    """Position of a row in the seeded shuffle: a hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffle(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Seeded shuffle: the same order on every run and any partitioning."""
    return df.orderBy(order_key(F.col(key), seed), key)


def take_fraction(df: DataFrame, key: str, weight: float, seed: int = SEED) -> DataFrame:
    """Exactly int(n * weight) rows: the first ones of the seeded shuffle.

    ``key`` must be unique.  Nothing is sorted and no limit funnels rows into
    one task: two rounds of counting hash prefixes (4096 counters each) find
    the prefix where the cut falls; rows before it are kept by comparison, and
    only rows sharing that prefix are ranked.
    """
    if weight == 1.0:
        return df
    hashed = df.withColumn("__h", order_key(F.col(key), seed))
    first = F.substring("__h", 1, RADIX_DIGITS)
    second = F.substring("__h", RADIX_DIGITS + 1, RADIX_DIGITS)

    def cut(counts: DataFrame) -> DataFrame:
        """The prefix in which position ``wanted`` falls, and what is left to take in it."""
        w = W.orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
        before = F.col("upto") - F.col("c")
        return (
            counts.withColumn("upto", F.sum("c").over(w))
            .filter((before <= F.col("wanted")) & (F.col("upto") > F.col("wanted")))
            .select("p", (F.col("wanted") - before).alias("rest"))
        )

    # Windows here see at most 4096 counters, whatever the table holds.
    by_first = hashed.groupBy(first.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    share = F.floor(F.sum("c").over(W.partitionBy()) * F.lit(float(weight))).cast("bigint")
    level1 = cut(by_first.withColumn("wanted", share))
    p1, rest1 = level1.select("p").scalar(), level1.select("rest").scalar()
    by_second = hashed.filter(first == p1).groupBy(second.alias("p")).agg(
        F.count(F.lit(1)).alias("c")
    )
    level2 = cut(by_second.withColumn("wanted", rest1))
    p2, rest2 = level2.select("p").scalar(), level2.select("rest").scalar()
    prefix = F.substring("__h", 1, 2 * RADIX_DIGITS)
    border = F.concat(p1, p2)
    # A weight of 1 or more has no cut: every prefix lies below 'g' then.
    below = hashed.filter(prefix < F.coalesce(border, F.lit("g")))
    rank = F.row_number().over(W.partitionBy("__p").orderBy("__h", key))
    edge = (
        hashed.filter(prefix == border)
        .withColumn("__p", prefix)
        .withColumn("__rank", rank)
        .filter(F.col("__rank") <= rest2)
        .drop("__p", "__rank")
    )
    return below.unionByName(edge).drop("__h")


def concat_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def weighted_mix(
    sources: Sequence[tuple[DataFrame, float]], key: str, seed: int = SEED
) -> DataFrame:
    """Weight each source, concatenate, shuffle; a single source keeps its order."""
    parts = [take_fraction(df, key, weight, seed) for df, weight in sources]
    if len(parts) == 1:
        return parts[0]
    return shuffle(concat_sources(*parts), key, seed)


def train_test_split(
    df: DataFrame, key: str, test_share: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add ``split``: each row decides from its own hash, in thousandths."""
    bucket = F.conv(F.substring(order_key(F.col(key), seed), 1, 8), 16, 10).cast("bigint") % 1000
    return df.withColumn(
        "split", F.when(bucket < int(round(test_share * 1000)), "test").otherwise("train")
    )


def cap_length(df: DataFrame, text: str = "text", max_tokens: int = 2048) -> DataFrame:
    """Cut to a number of whitespace-separated tokens; adds n_tokens (after)."""
    tokens = F.filter(F.split(F.col(text), r"[ \t\r\n\f\x0b]+"), lambda t: t != "")
    cut = F.slice(F.col("__tokens"), 1, max_tokens)
    return (
        df.withColumn("__tokens", tokens)
        .withColumn("n_tokens", F.least(F.size("__tokens"), F.lit(max_tokens)))
        .withColumn(
            text,
            F.when(F.size("__tokens") > max_tokens, F.array_join(cut, " ")).otherwise(F.col(text)),
        )
        .drop("__tokens")
    )


# Replacement words for augmentation, a small example table; pass your own.
SYNONYMS = {"error": "failure", "fast": "quick", "create": "make", "remove": "delete"}


def augment(
    df: DataFrame,
    key: str,
    text: str = "text",
    probability: float = 0.1,
    synonyms: dict[str, str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Random deletion and synonym replacement, each token by its own hash.

    A token is dropped with the given probability, else replaced with the same
    probability when it has a synonym.  Results do not depend on partitioning.
    """
    table = SYNONYMS if synonyms is None else synonyms
    threshold = int(probability * 1000)

    def draw(kind: str, position: Column) -> Column:
        seeded = F.concat(F.lit(f"{seed}:{kind}:"), F.col(key).cast("string"), F.lit(":"), position)
        return F.conv(F.substring(F.md5(seeded), 1, 8), 16, 10).cast("bigint") % 1000

    def change(token: Column, i: Column) -> Column:
        position = i.cast("string")
        replaced = None
        for word, other in table.items():
            replaced = (
                F.when(token == word, F.lit(other)) if replaced is None
                else replaced.when(token == word, F.lit(other))
            )
        out = F.when(draw("drop", position) < threshold, F.lit(None).cast("string"))
        if replaced is not None:
            swap = token.isin(*table) & (draw("swap", position) < threshold)
            out = out.when(swap, replaced)
        return out.otherwise(token)

    kept = F.array_compact(F.transform(F.split(F.col(text), " ", -1), change))
    return df.withColumn(text, F.array_join(kept, " "))


def to_pairwise(responses: DataFrame, prompt: str, response: str, score: str) -> DataFrame:
    """One pair per prompt: best against worst response, ties by text.

    Extremes are aggregated, so a prompt with very many responses costs two
    values per task; all pairs are never formed.
    """
    best = F.max(F.struct(F.col(score).alias("s"), F.col(response).alias("r")))
    worst = F.min(F.struct(F.col(score).alias("s"), F.col(response).alias("r")))
    return (
        responses.groupBy(prompt)
        .agg(best.alias("b"), worst.alias("w"))
        .filter(F.col("b.s") > F.col("w.s"))
        .select(
            prompt,
            F.col("b.r").alias("chosen"), F.col("w.r").alias("rejected"),
            F.col("b.s").alias("chosen_score"), F.col("w.s").alias("rejected_score"),
        )
    )


def to_pointwise(pairs: DataFrame, prompt: str) -> DataFrame:
    """Two labelled rows per pair: chosen 1, rejected 0."""
    return pairs.select(
        prompt,
        F.inline(
            F.array(
                F.struct(F.col("chosen").alias("response"), F.lit(1).alias("label")),
                F.struct(F.col("rejected").alias("response"), F.lit(0).alias("label")),
            )
        ),
    )


def group_by_length(df: DataFrame, text: str, key: str, partitions: int) -> DataFrame:
    """Rows of similar length in the same partition, sorted by length.

    The key's hash is part of the range, so one very common length is split.
    """
    length = F.length(text)
    return (
        df.withColumn("n_chars", length)
        .withColumn("__h", order_key(F.col(key)))
        .repartitionByRange(partitions, "n_chars", "__h")
        .sortWithinPartitions("n_chars", "__h")
        .drop("__h")
    )


def length_bucket(length: Column, width: int = 256) -> Column:
    return F.floor(length / width).cast("bigint")


def messages_from_turns(turns: DataFrame, key: str) -> DataFrame:
    """Turn rows to one row per conversation with ordered messages.

    A conversation is one training example, so its turns fit in one row.
    """
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(turn)),
            lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
        ).alias("messages")
    )


def format_examples(df: DataFrame, kind: str = "chat") -> DataFrame:
    """Add ``text`` in chat or instruction form; anything else passes through."""
    if kind == "chat":
        return df.withColumn("text", X.format_chat(F.col("messages")))
    if kind == "instruction":
        return df.withColumn(
            "text",
            X.format_instruction(F.col("instruction"), F.col("input"), F.col("output")),
        )
    return df


def adjacent_turns(turns: DataFrame, key: str) -> DataFrame:
    """(key, turn, query, response): each user turn with the assistant's next."""
    user = turns.filter(F.col("role") == "user").select(
        key, "turn", F.col("text").alias("query")
    )
    reply = turns.filter(F.col("role") == "assistant").select(
        key, (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return user.join(reply, [key, "turn"])
