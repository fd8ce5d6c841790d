"""Registered queries that run as streams over what is there (availableNow).

Append mode emits a window once the watermark has passed it; the SQL twins
keep just those windows: end <= last timestamp - delay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..session import scratch_dir
from ..sources.stores import read_store, write_store
from ..streaming import pipelines as P
from ..streaming import state as ST
from ..streaming import windows as SW
from .base import PATH, REPO, CONTENT, code_files, table, with_files
from .finding_queries import SECURITY_CTES
from .request_queries import F5_SQL, F7_SQL, LIMIT, WINDOW
from .scan_queries import FUNCTIONS, PERFORMANCE


def _events(spark, sf):
    events = P.read_table_stream(spark, sf, "events")
    return events.select(
        F.col("event_id"), F.col("user_id").alias("client"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("task_type"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.col("value").alias("duration_s"),
    )


def _files(spark, sf):
    from ..functions.languages import detect_language

    return (
        P.read_table_stream(spark, sf, "documents")
        .select(
            F.col("doc_id").alias("file_id"), F.expr(REPO).alias("repo_id"),
            F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"),
        )
        .withColumn("language", detect_language(F.col("path")))
    )


def _limited(accepted_only):
    def run(spark, sf):
        decided = ST.limit_stream(
            _events(spark, sf).select("client", "event_id", "ts"), LIMIT, WINDOW, accepted_only
        )
        return P.run_available(decided, scratch_dir(spark, "stream")).select(
            F.col("event_id").alias("request_id"), "client",
            F.col("allowed").cast("int").alias("allowed"),
        )
    return run


def j2(spark, sf):
    found = P.scan_stream(_files(spark, sf)).select("file_id", "rule_id", "line_start")
    return P.run_available(found, scratch_dir(spark, "stream"))


J2_SQL = with_files("""SELECT file_id, rule_id, CAST(line_start AS INT) AS line_start
FROM security_findings WHERE rule_id <> 'CS-AST001'
UNION ALL SELECT file_id, rule_id, CAST(line_start AS INT) FROM performance""",
                    *SECURITY_CTES, PERFORMANCE)


def j3(spark, sf):
    """Functions of files kept as a log of batches, read at their latest batch."""
    log, checkpoint = scratch_dir(spark, "log"), scratch_dir(spark, "checkpoint")
    P.append_changes(
        _files(spark, sf), log, checkpoint,
        lambda batch: S.functions(batch).select("file_id", "name", "start_line"),
    ).awaitTermination()
    rows = P.current_rows(spark.read.parquet(log), touched=P.touched_keys(spark, log))
    return rows.select("file_id", "name", "start_line")


J3_SQL = with_files("SELECT file_id, name, start_line FROM measured WHERE kind = 'function'",
                    *FUNCTIONS)


def j3_buckets(spark, sf):
    """Functions of files kept in buckets by a stream of three batches, one emptying files."""
    files = code_files(spark, sf, by_key=True).withColumn("version", F.lit(1))
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("file_id")).agg(
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    source, store, checkpoint = (scratch_dir(spark, n) for n in ("changes", "store", "checkpoint"))

    def functions(batch):
        return S.functions(batch).join(batch.select("file_id", "version"), "file_id").select(
            "file_id", F.concat("name", F.lit("_v"), F.col("version")).alias("name"), "start_line")

    def arrive(batch):
        # The stream goes on from its checkpoint: what has arrived since is one micro-batch.
        batch.write.mode("append").parquet(source)
        P.store_changes(
            spark.readStream.schema(files.schema).parquet(source), store, checkpoint, functions,
            buckets=16,
        ).awaitTermination()

    write_store(functions(files.limit(0)), store, ["file_id"], 16)
    # Files are dealt out and made once: the later batches read those of the first, listed here.
    # Its ``toxic``, null without a label, is no column of the stream.
    marked = files.join(labels, "file_id", "left")
    arrive(marked)
    first = spark.read.schema(marked.schema).parquet(source)
    arrive(first.where("toxic IS NOT NULL").drop("toxic").withColumn("version", F.lit(2)))
    arrive(first.where("toxic").drop("toxic").withColumn("content", F.lit(""))
           .withColumn("version", F.lit(3)))
    return read_store(spark, store)


J3_BUCKETS_SQL = with_files("""
SELECT file_id, concat(name, '_v', CASE WHEN file_id IN (SELECT doc_id FROM labels)
  THEN 2 ELSE 1 END) AS name, start_line FROM measured WHERE kind = 'function'
  AND file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", *FUNCTIONS)


def j4(spark, sf):
    counts = SW.task_counts(_events(spark, sf)).select(
        F.unix_micros("window_start").alias("window_start"), "task_type", "status", "n"
    )
    return P.run_available(counts, scratch_dir(spark, "stream"))


J4_SQL = """SELECT epoch_us(h) AS window_start, task_type, status, n FROM (
  SELECT date_trunc('hour', ts) AS h, event_type AS task_type,
    CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS status, count(*) AS n
  FROM events GROUP BY ALL)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"""


def j5(spark, sf):
    """Inner stream-stream join: every pair is emitted once both sides arrived."""
    events = _events(spark, sf)
    finish_us = F.unix_micros("ts") + F.floor(F.col("duration_s") * 60_000_000)
    both = events.select(
        F.col("event_id").alias("task_id"), "task_type",
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("phase"), F.col("ts").alias("at")),
                F.struct(F.lit("finish").alias("phase"), F.timestamp_micros(finish_us).alias("at")),
            )
        ).alias("p"),
    ).select("task_id", "task_type", F.col("p.phase").alias("phase"), F.col("p.at").alias("ts"))
    done = SW.task_durations(both, max_hours=3).select(
        "task_id", F.round("duration_s", 3).alias("duration_s")
    )
    return P.run_available(done, scratch_dir(spark, "stream"))


J5_SQL = """SELECT event_id AS task_id, round(floor(value * 60000000) / 1000000.0, 3) AS duration_s
FROM events WHERE floor(value * 60000000) <= 10800000000"""


def j6(spark, sf):
    edits = _events(spark, sf).select(F.col("client").alias("document"), "ts", "event_id")
    bursts = SW.debounced(edits, gap="2 hours").select(
        "document", F.unix_micros("last_ts").alias("last_ts"), "event_id", "edits"
    )
    return P.run_available(bursts, scratch_dir(spark, "stream"))


J6_SQL = """SELECT document, last_ts, event_id, edits FROM (
  SELECT document, max(us) AS last_ts, arg_max(event_id, us) AS event_id, count(*) AS edits FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY document ORDER BY us, event_id) AS burst FROM (
      SELECT user_id AS document, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts))
        OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh
      FROM events)) GROUP BY document, burst)
WHERE last_ts + 7200000000 <= (SELECT epoch_us(max(ts)) FROM events) - 10000000"""


def j7(spark, sf):
    events = _events(spark, sf)
    status = (
        F.when(F.col("task_type") == "purchase", "completed")
        .when(F.col("task_type") == "error", "failed")
        .when(F.col("task_type") == "signup", "queued").otherwise("running")
    )
    changes = ST.status_changes(
        events.select(F.col("client").alias("job_id"), "event_id", "ts", status.alias("status"))
    )
    told = ST.subscriber_updates(changes).select("job_id", "status", "event_id")
    return P.run_available(told, scratch_dir(spark, "stream"))


_STATUS = """CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
  WHEN 'signup' THEN 'queued' ELSE 'running' END"""
J7_SQL = f"""SELECT job_id, status, event_id FROM (SELECT user_id AS job_id, event_id, {_STATUS} AS status,
    lag({_STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE status IN ('completed', 'failed') AND (previous IS NULL OR previous <> status)"""


def j8(spark, sf):
    alerts = SW.alert_windows(
        _events(spark, sf), F.col("status") == "failure", max_error_rate=0.3, max_p99=250.0
    ).select(F.unix_micros("window_start").alias("window_start"), "n", "errors", "p99")
    return P.run_available(alerts, scratch_dir(spark, "stream"))


J8_SQL = """SELECT epoch_us(h) AS window_start, n, errors, p99 FROM (
  SELECT date_trunc('hour', ts) AS h, count(*) AS n,
    count(*) FILTER (event_type = 'error') AS errors,
    list(value ORDER BY value)[CAST(ceil(count(*) * 0.99) AS INT)] AS p99
  FROM events GROUP BY 1)
WHERE (errors / n > 0.3 OR p99 > 250)
  AND h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"""


def j9(spark, sf):
    rate = SW.throughput(_events(spark, sf), "task_type").select(
        F.unix_micros("minute").alias("minute"), "task_type", "requests", "peak_per_second"
    )
    return P.run_available(rate, scratch_dir(spark, "stream"))


J9_SQL = """SELECT epoch_us(m) AS minute, task_type, CAST(sum(n) AS BIGINT) AS requests,
  max(n) AS peak_per_second
FROM (SELECT date_trunc('minute', ts) AS m, date_trunc('second', ts) AS s, event_type AS task_type,
    count(*) AS n FROM events GROUP BY ALL)
WHERE m + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES
GROUP BY m, task_type"""

QUERIES = {
    "j1_rate_limit_stream": (
        _limited(False), f"SELECT request_id, client, allowed FROM ({F5_SQL})"),
    "j1_accepted_limit_stream": (
        _limited(True), f"SELECT request_id, client, allowed FROM ({F7_SQL})"),
    "j2_scan_stream": (j2, J2_SQL),
    "j3_index_stream": (j3, J3_SQL),
    "j3_index_buckets": (j3_buckets, J3_BUCKETS_SQL),
    "j4_task_counts_stream": (j4, J4_SQL),
    "j5_task_durations_stream": (j5, J5_SQL),
    "j6_debounce_stream": (j6, J6_SQL),
    "j7_status_stream": (j7, J7_SQL),
    "j8_alert_stream": (j8, J8_SQL),
    "j9_throughput_stream": (j9, J9_SQL),
}
