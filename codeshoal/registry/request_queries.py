"""Registered queries: rate limits, counters, latency, event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import requests as RQ
from ..streaming import windows as SW
from .base import table

LIMIT, WINDOW = 5, 86_400


def requests(spark, sf):
    """Events as a request log, timestamps in UTC."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("client"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.when(F.col("event_type") == "view", "/health/")
            .when(F.col("event_type") == "click", "/metricsx")
            .otherwise("/api/"), F.col("event_type"),
        ).alias("path"),
        F.col("event_type").alias("task_type"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.col("value").alias("duration_s"),
        F.col("event_id").alias("event_id"),
    )


def c11(spark, sf):
    return RQ.without_exempt(requests(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


C11_SQL = """SELECT concat('/api/', event_type) AS path, count(*) AS n FROM events
WHERE event_type NOT IN ('view', 'click') GROUP BY 1"""


def f5(spark, sf):
    return RQ.sliding_rate_limit(requests(spark, sf), LIMIT, WINDOW).select(
        "request_id", "client", "in_window", F.col("allowed").cast("int").alias("allowed")
    )


WINDOWED = f"""w AS (SELECT *, count(*) OVER f AS in_window, min(us) OVER f AS oldest
  FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events)
  WINDOW f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {WINDOW * 10**6 - 1} PRECEDING
    AND 1 PRECEDING))"""
F5_SQL = f"""WITH {WINDOWED} SELECT event_id AS request_id, user_id AS client, in_window,
  CASE WHEN in_window < {LIMIT} THEN 1 ELSE 0 END AS allowed FROM w"""


def f6(spark, sf):
    return RQ.sliding_rate_limit(requests(spark, sf), LIMIT, WINDOW).select(
        "request_id", "retry_after", "remaining", "reset_at"
    )


F6_SQL = f"""WITH {WINDOWED} SELECT event_id AS request_id,
  CAST(CASE WHEN in_window < {LIMIT} THEN 0
    ELSE greatest(0, (oldest + {WINDOW * 10**6} - us) // 1000000) END AS INT) AS retry_after,
  CAST(greatest(0, {LIMIT} - in_window - 1) AS INT) AS remaining,
  CAST((coalesce(oldest, us) + {WINDOW * 10**6}) // 1000000 AS BIGINT) AS reset_at FROM w"""


def f7(spark, sf):
    return RQ.accepted_rate_limit(requests(spark, sf), LIMIT, WINDOW).select(
        "request_id", "client", F.col("allowed").cast("int").alias("allowed"), "retry_after"
    )


# Requests one after the other; the state is the list of accepted times.
F7_SQL = f"""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (
  SELECT event_id, user_id, us, n, [us] AS kept, 1 AS allowed, CAST(0 AS BIGINT) AS retry_after
    FROM r WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, us, n, CASE WHEN len(live) < {LIMIT} THEN list_append(live, us) ELSE live END,
    CASE WHEN len(live) < {LIMIT} THEN 1 ELSE 0 END,
    CASE WHEN len(live) < {LIMIT} THEN 0
      ELSE CAST(greatest(0, (live[1] + {WINDOW * 10**6} - us) // 1000000) AS BIGINT) END
  FROM (SELECT r.event_id, r.user_id, r.us, r.n,
      list_filter(run.kept, lambda k: r.us - k < {WINDOW * 10**6}) AS live
    FROM run JOIN r ON r.user_id = run.user_id AND r.n = run.n + 1))
SELECT event_id AS request_id, user_id AS client, allowed, retry_after FROM run"""


def e9(spark, sf):
    return RQ.error_rate(requests(spark, sf), F.col("status") == "failure", "client").select(
        "client", "request_count", "error_count", F.round("error_rate", 6).alias("error_rate")
    )


E9_SQL = """SELECT user_id AS client, count(*) AS request_count,
  count(*) FILTER (event_type = 'error') AS error_count,
  round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate
FROM events GROUP BY user_id"""


def e10(spark, sf):
    return RQ.task_counter(requests(spark, sf))


E10_SQL = """SELECT event_type AS task_type, CASE event_type WHEN 'error' THEN 'failure'
  ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY ALL"""


def e11(spark, sf):
    return RQ.duration_histogram(requests(spark, sf), "duration_s", "task_type")


_BUCKETS = " UNION ALL ".join(
    f"SELECT event_type AS task_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS n"
    " FROM events GROUP BY event_type"
    for b in (1, 5, 10, 30, 60, 120, 300, 600)
)
E11_SQL = (
    _BUCKETS + " UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY event_type"
)


def e12(spark, sf):
    stats = RQ.latency_stats(requests(spark, sf), "task_type", "duration_s")
    return stats.select(
        "task_type", "n", F.round("avg_value", 6).alias("avg_value"), "min_value", "max_value",
        F.col("quantile_value").alias("p95"),
    )


E12_SQL = """SELECT event_type AS task_type, count(*) AS n, round(avg(value), 6) AS avg_value,
  min(value) AS min_value, max(value) AS max_value,
  list(value ORDER BY value)[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95
FROM events GROUP BY event_type"""


def e12_clients(spark, sf):
    stats = RQ.latency_stats(requests(spark, sf), "client", "duration_s")
    return stats.select("client", "n", F.col("quantile_value").alias("p95"))


E12_CLIENTS_SQL = """SELECT user_id AS client, count(*) AS n,
  list(value ORDER BY value)[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95
FROM events GROUP BY user_id"""


def _us(name):
    return F.unix_micros(name).alias(name)


def j4(spark, sf):
    return SW.task_counts(requests(spark, sf)).select(
        _us("window_start"), "task_type", "status", "n"
    )


J4_SQL = """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type AS task_type,
  CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS status, count(*) AS n
FROM events GROUP BY ALL"""


def tasks(spark, sf):
    """Start and finish events of tasks: a finish follows by its value in minutes."""
    events = requests(spark, sf)
    start = events.select(
        F.col("event_id").alias("task_id"), "task_type", "ts", F.lit("start").alias("phase")
    )
    micros = F.unix_micros("ts") + F.floor(F.col("duration_s") * 60_000_000)
    finish = events.select(
        F.col("event_id").alias("task_id"), "task_type",
        F.timestamp_micros(micros).alias("ts"), F.lit("finish").alias("phase"),
    )
    return start.unionByName(finish)


def j5(spark, sf):
    done = SW.task_durations(tasks(spark, sf), max_hours=3)
    return RQ.duration_histogram(
        done.withColumn("minutes", F.col("duration_s") / 60), "minutes", "task_type"
    )


_J5_BUCKETS = " UNION ALL ".join(
    f"SELECT event_type AS task_type, '{b}' AS le, count(*) FILTER (m <= {b}) AS n FROM d GROUP BY 1"
    for b in (1, 5, 10, 30, 60, 120, 300, 600)
)
J5_SQL = f"""WITH d AS (SELECT event_type, floor(value * 60000000) / 60000000 AS m FROM events
  WHERE floor(value * 60000000) <= 10800000000)
{_J5_BUCKETS} UNION ALL SELECT event_type, '+Inf', count(*) FROM d GROUP BY 1"""


def edits(spark, sf):
    return requests(spark, sf).select(F.col("client").alias("document"), "ts", "event_id")


def j6(spark, sf):
    return SW.debounced(edits(spark, sf), gap="2 hours").select(
        "document", _us("first_ts"), _us("last_ts"), "event_id", "edits"
    )


J6_SQL = """SELECT document, min(us) AS first_ts, max(us) AS last_ts,
  arg_max(event_id, us) AS event_id, count(*) AS edits FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY document ORDER BY us, event_id) AS burst FROM (
    SELECT user_id AS document, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts))
      OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh
    FROM events)) GROUP BY document, burst"""


def job_events(spark, sf):
    """Events as status changes of one job per user."""
    status = (
        F.when(F.col("task_type") == "purchase", "completed")
        .when(F.col("task_type") == "error", "failed")
        .when(F.col("task_type") == "signup", "queued").otherwise("running")
    )
    return requests(spark, sf).select(
        F.col("client").alias("job_id"), "ts", "event_id", status.alias("status")
    )


def j7(spark, sf):
    return J.latest_status(job_events(spark, sf)).select(
        "job_id", "status", "event_id", F.col("is_final").cast("int").alias("is_final")
    )


_STATUS = """CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
  WHEN 'signup' THEN 'queued' ELSE 'running' END"""
J7_SQL = f"""SELECT user_id AS job_id, status, event_id,
  CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END AS is_final
FROM (SELECT *, {_STATUS} AS status, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def j8(spark, sf):
    alerts = SW.alert_windows(
        requests(spark, sf), F.col("status") == "failure", max_error_rate=0.3, max_p99=250.0
    )
    return alerts.select(
        _us("window_start"), "n", "errors", F.round("error_rate", 6).alias("error_rate"), "p99",
        F.col("error_alert").cast("int").alias("error_alert"),
        F.col("latency_alert").cast("int").alias("latency_alert"),
    )


J8_SQL = """SELECT window_start, n, errors, round(errors / n, 6) AS error_rate, p99,
  CASE WHEN errors / n > 0.3 THEN 1 ELSE 0 END AS error_alert,
  CASE WHEN p99 > 250 THEN 1 ELSE 0 END AS latency_alert
FROM (SELECT epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS n,
    count(*) FILTER (event_type = 'error') AS errors,
    list(value ORDER BY value)[CAST(ceil(count(*) * 0.99) AS INT)] AS p99
  FROM events GROUP BY 1) WHERE errors / n > 0.3 OR p99 > 250"""


def j8_backlog(spark, sf):
    return RQ.backlog(
        SW.queue_flow(
            requests(spark, sf), F.col("task_type").isin("signup", "view", "click"),
            F.col("task_type").isin("purchase", "error"), width="6 hours",
        ),
        limit=100,
    ).select(_us("window_start"), "net", "backlog", F.col("alert").cast("int").alias("alert"))


J8_BACKLOG_SQL = """SELECT window_start, net, CAST(sum(net) OVER (ORDER BY window_start) AS BIGINT) AS backlog,
  CASE WHEN sum(net) OVER (ORDER BY window_start) > 100 THEN 1 ELSE 0 END AS alert
FROM (SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS window_start,
    count(*) FILTER (event_type IN ('signup', 'view', 'click'))
    - count(*) FILTER (event_type IN ('purchase', 'error')) AS net FROM events GROUP BY 1)"""


def j9(spark, sf):
    return SW.throughput(requests(spark, sf), "task_type").select(
        _us("minute"), "task_type", "requests", "peak_per_second",
        F.round("requests_per_second", 6).alias("requests_per_second"),
    )


J9_SQL = """SELECT epoch_us(date_trunc('minute', s)) AS minute, task_type,
  CAST(sum(n) AS BIGINT) AS requests, max(n) AS peak_per_second,
  round(sum(n) / 60.0, 6) AS requests_per_second
FROM (SELECT date_trunc('second', ts) AS s, event_type AS task_type, count(*) AS n
  FROM events GROUP BY ALL) GROUP BY ALL"""

QUERIES = {
    "c11_exempt_paths": (c11, C11_SQL),
    "f5_rate_limit": (f5, F5_SQL),
    "f6_retry_after": (f6, F6_SQL),
    "f7_accepted_rate_limit": (f7, F7_SQL),
    "e9_error_rate": (e9, E9_SQL),
    "e10_task_counter": (e10, E10_SQL),
    "e11_duration_histogram": (e11, E11_SQL),
    "e12_latency_stats": (e12, E12_SQL),
    "e12_latency_by_client": (e12_clients, E12_CLIENTS_SQL),
    "j4_task_counts": (j4, J4_SQL),
    "j5_task_durations": (j5, J5_SQL),
    "j6_debounce": (j6, J6_SQL),
    "j7_latest_status": (j7, J7_SQL),
    "j8_alert_windows": (j8, J8_SQL),
    "j8_backlog": (j8_backlog, J8_BACKLOG_SQL),
    "j9_throughput": (j9, J9_SQL),
}
