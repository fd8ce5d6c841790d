"""Per-key state machines on streams.

Rows of one key reach a call in any order, so each call sorts its rows by
time.  State is small and expires: timestamps inside the window, or the last
status.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import catalogs as C


class RateLimiter(StatefulProcessor):
    """Decide each request against the earlier ones of its client.

    ``accepted_only`` chooses which earlier requests occupy the window.
    """

    def __init__(self, limit: int, window_us: int, accepted_only: bool, expire: bool):
        self.limit, self.window_us, self.accepted_only = limit, window_us, accepted_only
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState(
            "recent", T.StructType([T.StructField("us", T.LongType())])
        )
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"])
        stored = [int(row[0]) for row in self.recent.get()] if self.recent.exists() else []
        past = sorted(stored)
        decisions = []
        head = 0
        for us in batch["us"]:
            while head < len(past) and us - past[head] >= self.window_us:
                head += 1
            earlier = len(past) - head
            if not self.accepted_only:
                # Requests of the same instant do not count against each other.
                earlier -= len(past) - bisect_left(past, us)
            ok = earlier < self.limit
            decisions.append(ok)
            if ok or not self.accepted_only:
                # In order also for a row that is late.
                insort(past, int(us), lo=head)
        self.recent.put([(us,) for us in past[head:]])
        if self.expire:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            last = max(past, default=0)
            self.handle.registerTimer((last + self.window_us) // 1000 + 1)
        yield pd.DataFrame(
            {"client": key[0], "event_id": batch["event_id"].values,
             "us": batch["us"].values, "allowed": decisions}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The watermark has passed the whole window: nothing in it can count.
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(
    requests: DataFrame,
    limit: int = C.RATE_LIMIT,
    window_seconds: int = C.RATE_WINDOW_SECONDS,
    accepted_only: bool = False,
    delay: str | None = None,
) -> DataFrame:
    """Rate-limit decisions on a stream of (client, event_id, ts).

    With ``delay`` the stream gets a watermark and idle clients are forgotten
    once it has passed their window; without it each client keeps the
    timestamps that were inside the window at its last request.
    """
    if delay is not None:
        requests = requests.withWatermark("ts", delay)
    keyed = requests.select("client", "event_id", "ts", F.unix_micros("ts").alias("us"))
    schema = f"client {dict(keyed.dtypes)['client']}, event_id bigint, us bigint, allowed boolean"
    return keyed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=RateLimiter(
            limit, window_seconds * 1_000_000, accepted_only, delay is not None
        ),
        outputStructType=schema, outputMode="Append",
        timeMode="None" if delay is None else "EventTime",
    )


class StatusTracker(StatefulProcessor):
    """Emit a job's status whenever a later event changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(
            "last",
            T.StructType(
                [T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType()),
                 T.StructField("status", T.StringType())]
            ),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"])
        current = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for us, event_id, status in zip(batch["us"], batch["event_id"], batch["status"]):
            event = (int(us), int(event_id), status)
            if current is not None and event[:2] <= current[:2]:
                continue
            if current is None or status != current[2]:
                out.append((key[0], status, event[1], event[0]))
            current = event
        if current is not None:
            self.last.update(current)
        yield pd.DataFrame(out, columns=["job_id", "status", "event_id", "us"])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame) -> DataFrame:
    """Status changes on a stream of (job_id, event_id, ts, status)."""
    keyed = events.select(
        "job_id", "event_id", "status",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    schema = (
        f"job_id {dict(keyed.dtypes)['job_id']}, status string, event_id bigint, us bigint"
    )
    return keyed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StatusTracker(), outputStructType=schema,
        outputMode="Append", timeMode="None",
    )


def subscriber_updates(changes: DataFrame) -> DataFrame:
    """What subscribers are told: completed and failed jobs."""
    return changes.filter(F.col("status").isin("completed", "failed"))
