"""Request logs: rate limiting, counters, latency.

A client may send a third of all requests.  Its timeline is therefore cut
into buckets as long as the window, and every request is also copied into the
next bucket as context; the window function then runs per client *and*
bucket, and only a bucket's own rows leave it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalogs as C


def without_exempt(requests: DataFrame, prefixes: Sequence[str] = C.EXEMPT_PATHS) -> DataFrame:
    """Drop requests whose path starts with an exempt prefix."""
    hit = None
    for prefix in prefixes:
        test = F.col("path").startswith(prefix)
        hit = test if hit is None else hit | test
    return requests.filter(~hit)


def _bucketed(requests: DataFrame, window_us: int, ahead: int = 1) -> DataFrame:
    """Requests with (us, bucket, own): own rows plus a copy in each of the next buckets."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    home = F.floor(F.col("us") / F.lit(window_us)).cast("bigint")
    return (
        requests.withColumn("us", us)
        .withColumn(
            "__copy",
            F.explode(
                F.array(*[
                    F.struct((home + i).alias("bucket"), F.lit(i == 0).alias("own"))
                    for i in range(ahead + 1)
                ])
            ),
        )
        .select("*", "__copy.bucket", "__copy.own")
        .drop("__copy")
    )


def sliding_rate_limit(
    requests: DataFrame, limit: int = C.RATE_LIMIT, window_seconds: int = C.RATE_WINDOW_SECONDS
) -> DataFrame:
    """Shared-log limit: all earlier requests in the window count, rejected too.

    Adds in_window, allowed, retry_after, remaining and reset_at (seconds).
    """
    window_us = window_seconds * 1_000_000
    frame = (
        W.partitionBy("client", "bucket").orderBy("us").rangeBetween(-(window_us - 1), -1)
    )
    counted = (
        _bucketed(requests, window_us)
        .withColumn("in_window", F.count(F.lit(1)).over(frame))
        .withColumn("__oldest", F.min("us").over(frame))
        .filter("own")
    )
    oldest = F.coalesce("__oldest", "us")
    allowed = F.col("in_window") < limit
    wait = F.floor((oldest + window_us - F.col("us")) / 1_000_000)
    return (
        counted.withColumn("allowed", allowed)
        .withColumn(
            "retry_after",
            F.when(F.col("allowed"), F.lit(0)).otherwise(F.greatest(F.lit(0), wait)).cast("int"),
        )
        .withColumn(
            "remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("in_window") - 1).cast("int")
        )
        .withColumn("reset_at", F.floor((oldest + window_us) / 1_000_000).cast("bigint"))
        .drop("bucket", "own", "__oldest")
    )


def _pieces(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Cut each client's requests where the state of its window is known.

    A request is accepted for certain if no more than ``limit`` requests, itself and those of
    the same instant included, lie in the window that ends with it.  Where that holds for all
    requests of one whole window, just these occupy it, so what follows can be decided
    without anything before.  Each bucket is cut at most once, at its first such place.
    Rows are (..., us, piece, own): a piece has its own requests and, with ``own`` false, those
    that occupy the window where it begins.
    """
    part = W.partitionBy("client", "bucket").orderBy("us")
    crowded = F.count(F.lit(1)).over(part.rangeBetween(-(window_us - 1), 0)) > limit
    doubt = F.max("__crowded").over(part.rangeBetween(-(window_us - 1), -1))
    # Two buckets back: one for the requests before, one for the window of each of them.
    own = (
        _bucketed(requests, window_us, 2)
        .withColumn("__crowded", crowded)
        .withColumn("__known", ~F.coalesce(doubt, F.lit(False)))
        .filter("own")
        .drop("own", "__crowded")
    )
    # One row per client and bucket: bounded by the time span, not by requests.
    by_bucket = W.partitionBy("__client").orderBy("__bucket")
    cuts = (
        own.groupBy(F.col("client").alias("__client"), F.col("bucket").alias("__bucket"))
        .agg(F.min(F.when(F.col("__known"), F.col("us"))).alias("__cut"))
        .withColumn("__before", F.max("__cut").over(
            by_bucket.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("__next", F.max("__cut").over(by_bucket.rangeBetween(1, 1)))
    )
    us, cut, following = F.col("us"), F.col("__cut"), F.col("__next")

    def member(piece: Column, own: bool) -> Column:
        return F.struct(piece.alias("piece"), F.lit(own).alias("own"))

    members = F.array_compact(F.array(
        member(F.coalesce(F.when(cut <= us, cut), F.col("__before")), True),
        F.when(us < cut, member(cut, False)),
        F.when(us > following - window_us, member(following, False)),
    ))
    return (
        own.join(cuts, F.col("client").eqNullSafe(F.col("__client"))
                 & (F.col("bucket") == F.col("__bucket")))
        .withColumn("__member", F.explode(members))
        .select("*", "__member.piece", "__member.own")
        .drop("bucket", "__known", "__client", "__bucket", "__cut", "__before", "__next",
              "__member")
    )


def accepted_rate_limit(
    requests: DataFrame,
    limit: int = C.RATE_LIMIT,
    window_seconds: int = C.RATE_WINDOW_SECONDS,
    tie: str = "request_id",
) -> DataFrame:
    """In-memory limit: only accepted requests occupy the window.

    Each decision depends on the ones before it, so the pieces of a client (see _pieces) are
    read in order, each by itself and streamed batch by batch; the state is at most
    ``limit`` timestamps.  A client that never stays below the limit for a whole window is
    one piece.  Requests without a time are left out.
    """
    window_us = window_seconds * 1_000_000
    pieces = _pieces(requests, limit, window_us).select("client", "piece", tie, "us", "own")
    ordered = pieces.repartition("client", "piece").sortWithinPartitions(
        "client", "piece", "us", tie
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = None
        accepted: deque[int] = deque()
        for batch in batches:
            verdicts, waits = [], []
            for client, start, us, own in zip(
                    batch["client"], batch["piece"], batch["us"], batch["own"]):
                if (client, start) != piece:
                    piece = (client, start)
                    accepted.clear()
                while accepted and us - accepted[0] >= window_us:
                    accepted.popleft()
                ok = not own or len(accepted) < limit
                verdicts.append(ok)
                waits.append(0 if ok else max(0, (accepted[0] + window_us - us) // 1_000_000))
                if ok:
                    accepted.append(us)
            decided = batch.assign(allowed=verdicts, retry_after=waits)
            yield decided[batch["own"]].drop(columns="own")

    types = dict(pieces.dtypes)
    schema = (
        f"client {types['client']}, piece bigint, {tie} {types[tie]}, us bigint, "
        "allowed boolean, retry_after bigint"
    )
    return ordered.mapInPandas(decide, schema)


# --- counters and latency -------------------------------------------------------


def error_rate(requests: DataFrame, is_error: Column, *keys: str) -> DataFrame:
    """errors / max(1, requests), per key or overall."""
    counted = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(is_error).alias("error_count")
    )
    return counted.withColumn(
        "error_rate", F.col("error_count") / F.greatest(F.lit(1), F.col("request_count"))
    )


def task_counter(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_type", "status").agg(F.count(F.lit(1)).alias("n"))


def duration_histogram(
    tasks: DataFrame, duration: str, *keys: str, buckets: Sequence[int] = C.DURATION_BUCKETS
) -> DataFrame:
    """Cumulative counts per bucket bound (le), '+Inf' last.

    One conditional count per bucket in a single aggregation, then unpivoted.
    """
    counts = [F.count_if(F.col(duration) <= b).alias(f"le_{b}") for b in buckets]
    wide = tasks.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("le_inf"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{b}").alias("n")) for b in buckets]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return wide.select(*keys, F.inline(F.array(*rows)))


def latency_stats(
    requests: DataFrame, key: str, value: str, quantile: float = 0.95, margin: float = 0.002
) -> DataFrame:
    """count, avg, min, max and the exact nearest-rank quantile per key.

    The quantile is the value at 0-based position int(n * q) of the sorted
    values.  No group is sorted whole, and none need lie in one task: a sketch gives cuts
    close around the position, one pass counts the values between each two cuts, and only
    values of the slice that holds the position are ranked, one row per distinct value.
    Counts are exact wherever the cuts lie; the sketch only decides how long the slice is
    (about 0.00004 of a group for the given margin).
    """
    accuracy, steps = 100_000, 100
    points = sorted({min(1.0, max(0.0, quantile + margin * i / steps))
                     for i in range(-steps, steps + 1)})
    overall = requests.groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("avg_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.percentile_approx(value, F.array(*map(F.lit, points)), accuracy).alias("__cuts"),
    ).withColumn("__rank", F.floor(F.col("n") * F.lit(quantile)).cast("bigint"))
    cuts = overall.where("n > 0").select(
        F.col(key).alias("__key"), "__rank", F.array_distinct("__cuts").alias("__cuts"))
    own = F.col(value)
    valued = requests.where(own.isNotNull()).select(key, value)
    # Most values lie outside the cuts, where two comparisons tell the slice.
    place = (
        F.when(own < F.get("__cuts", F.lit(0)), 0)
        .when(own > F.element_at("__cuts", -1), F.size("__cuts") + 1)
        .otherwise(F.size(F.filter("__cuts", lambda cut: cut < own)) + 1)
    )
    # A group has at most len(points) + 2 slices.
    slices = (
        valued.join(cuts, F.col(key).eqNullSafe(F.col("__key")))
        .groupBy("__key", "__rank", place.alias("__slice"))
        .agg(F.count(F.lit(1)).alias("__c"), F.min(value).alias("__low"), F.max(value).alias("__high"))
        .groupBy("__key", "__rank")
        .agg(F.array_sort(F.collect_list(F.struct("__slice", "__c", "__low", "__high"))).alias("__all"))
        .withColumn("__upto", F.transform("__all", lambda _, i: F.aggregate(
            F.slice("__all", 1, i + 1), F.lit(0).cast("bigint"), lambda n, s: n + s["__c"])))
        .withColumn("__at", F.size(F.filter("__upto", lambda n: n <= F.col("__rank"))))
        .select("__key", (F.col("__rank") - F.coalesce(
            F.get("__upto", F.col("__at") - 1), F.lit(0))).alias("__rank"),
            F.get("__all", "__at").alias("__held"))
        .where("__held IS NOT NULL")
        .select("__key", "__rank", "__held.__low", "__held.__high")
    )
    counted = (
        valued.join(slices, F.col(key).eqNullSafe(F.col("__key")))
        .where((own >= F.col("__low")) & (own <= F.col("__high")))
        .groupBy("__key", "__rank", own.alias("__value")).agg(F.count(F.lit(1)).alias("__c"))
    )
    w = W.partitionBy("__key").orderBy("__value")
    at_rank = (
        counted.withColumn("__upto", F.sum("__c").over(w))
        .filter((F.col("__upto") > F.col("__rank"))
                & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
        .select("__key", F.col("__value").alias("quantile_value"))
    )
    # A null key is a group, and a key without values has no quantile.
    return overall.drop("__cuts", "__rank").join(
        at_rank, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def backlog(flow: DataFrame, limit: int = 1000) -> DataFrame:
    """Running queue length per window from its net growth, with an alert flag.

    The running sum is taken in two steps, inside each day and over the days'
    totals, so one task never holds more windows than a day has, or days.
    """
    day = F.date_trunc("day", "window_start")
    inside = W.partitionBy("__day").orderBy("window_start").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    # One row per day: a century is 36,525 rows.
    before = W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    daily = flow.withColumn("__day", day)
    totals = (
        daily.groupBy("__day").agg(F.sum("net").alias("__net"))
        .withColumn("__carried", F.coalesce(F.sum("__net").over(before), F.lit(0)))
        .drop("__net")
    )
    return (
        daily.join(totals, "__day")
        .withColumn("backlog", F.col("__carried") + F.sum("net").over(inside))
        .withColumn("alert", F.col("backlog") > limit)
        .drop("__day", "__carried")
    )
