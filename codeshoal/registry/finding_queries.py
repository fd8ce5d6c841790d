"""Registered queries: the findings table and what is computed from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..operators import findings as FN
from ..operators import jobs as J
from ..plans import analysis as A
from ..sources import sinks
from ..session import scratch_dir
from .base import LINES, code_files, sql_text, table, with_files
from .scan_queries import (
    BEGIN, FLOWS, FUNCTIONS, METRICS, PERFORMANCE, SECURITY, TAINT, TAINT_FINDINGS,
)

_SUGGESTIONS = ", ".join(
    f"('{r.rule_id}', {sql_text(r.remediation)})" for r in C.SECURITY_RULES
)
_DANGEROUS = ", ".join(f"('{k}', '{n}')" for k, v in C.DANGEROUS_FUNCTIONS.items() for n in v)
SECURITY_FINDINGS = f"""security_findings AS (
  SELECT s.rule_id, s.severity, s.confidence, s.file_id, f.repo_id, s.path, s.language,
    CAST(s.line_start AS INT) AS line_start, {BEGIN} AS column_start, s.cwe_id, s.owasp_category,
    g.suggestion
  FROM security s JOIN code_files f USING (file_id)
    JOIN (VALUES {_SUGGESTIONS}) g(rule_id, suggestion) USING (rule_id)
  UNION ALL
  SELECT 'CS-AST001', 'high', 'medium', m.file_id, m.repo_id, m.path, m.language, m.start_line,
    NULL, 'CWE-94', 'A03', 'Avoid using dangerous functions; use safer alternatives'
  FROM measured m JOIN (VALUES {_DANGEROUS}) d(language, name) USING (language, name)
  WHERE m.kind = 'function')"""
ALL_FINDINGS = """all_findings AS (
  SELECT 'security' AS finding_type, rule_id, severity, confidence, file_id, path, line_start
    FROM security_findings
  UNION ALL SELECT 'performance', rule_id, severity, NULL, file_id, path, line_start FROM performance
  UNION ALL SELECT 'performance', CASE WHEN complexity > 50 THEN 'PERF-C001' ELSE 'PERF-C002' END,
    CASE WHEN complexity > 50 THEN 'high' ELSE 'medium' END, NULL, file_id, path, start_line
    FROM metrics WHERE complexity > 20
  UNION ALL SELECT 'performance', 'PERF-S001', 'medium', NULL, file_id, path, start_line
    FROM metrics WHERE loc > 100
  UNION ALL SELECT 'performance', 'PERF-N001', 'medium', NULL, file_id, path, start_line
    FROM metrics WHERE least(complexity // 3, 10) > 4
  UNION ALL SELECT 'performance', 'PERF-P006', 'low', NULL, m.file_id, m.path, l.line_no
    FROM measured m JOIN mlines l ON l.file_id = m.file_id
      AND l.line_no BETWEEN m.start_line AND m.end_line
    WHERE m.kind = 'function' AND m.language = 'python'
      AND regexp_matches(l.raw, '^\\s*(import|from) ')
  UNION ALL SELECT 'taint', concat('TAINT-', upper(sink_type)), severity, NULL, file_id, path,
    line_start FROM taint_findings)"""
SECURITY_CTES = (LINES, SECURITY, *FUNCTIONS, SECURITY_FINDINGS)
ALL_CTES = (*SECURITY_CTES, METRICS, PERFORMANCE, TAINT, FLOWS, TAINT_FINDINGS, ALL_FINDINGS)


def _security(spark, sf):
    return A.security_findings(code_files(spark, sf))


def _all(spark, sf):
    return A.analyze(code_files(spark, sf))


def l1(spark, sf):
    return A.findings_by_category(code_files(spark, sf))


_TITLES = ", ".join(f"('{k}', {sql_text(v)})" for k, v in C.OWASP_TITLES.items())
L1_SQL = with_files(f"""
SELECT language, severity, coalesce(owasp_category, 'unmapped') AS category, count(*) AS n_findings,
  count(*) FILTER (confidence = 'high') AS n_certain, min(line_start) AS first_line,
  coalesce(t.title, 'Unmapped') AS title
FROM security_findings LEFT JOIN (VALUES {_TITLES}) t(code, title) ON code = owasp_category
GROUP BY ALL""", *SECURITY_CTES)


def h1(spark, sf):
    return _all(spark, sf).groupBy("finding_type", "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_start").alias("line_sum")
    )


H1_SQL = with_files("""SELECT finding_type, rule_id, severity, count(*) AS n,
  CAST(sum(line_start) AS BIGINT) AS line_sum FROM all_findings GROUP BY ALL""", *ALL_CTES)


def c2(spark, sf):
    kept = FN.filter_findings(_all(spark, sf), severity="high", finding_type="security")
    return kept.select("file_id", "rule_id", "line_start", "path")


C2_SQL = with_files("""SELECT file_id, rule_id, line_start, path FROM all_findings
WHERE severity = 'high' AND finding_type = 'security'""", *ALL_CTES)


def c10(spark, sf):
    outputs = {name: build(code_files(spark, sf)) for name, build in A.ANALYSES.items()}
    chosen = FN.select_analyses(outputs, ["performance", "taint"])
    return chosen.groupBy("finding_type", "severity").agg(F.count(F.lit(1)).alias("n"))


C10_SQL = with_files("""SELECT finding_type, severity, count(*) AS n FROM all_findings
WHERE finding_type IN ('performance', 'taint') GROUP BY ALL""", *ALL_CTES)


def c3(spark, sf):
    """Listed rules of a category for each language of the files at hand."""
    rules = FN.filter_rules(FN.listed_rules(spark), "security", "python")
    files = code_files(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    listed = rules.select("id", "severity", F.explode("languages").alias("language"))
    return files.join(F.broadcast(listed), "language")


C3_SQL = with_files("""
SELECT language, count(*) AS files, id, 'high' AS severity FROM code_files JOIN (VALUES
  ('sql-injection', 'python'), ('sql-injection', 'javascript'), ('sql-injection', 'java'),
  ('sql-injection', 'php'), ('xss-detection', 'javascript'), ('xss-detection', 'php'),
  ('xss-detection', 'python')) r(id, language) USING (language) GROUP BY ALL""")


def c5(spark, sf):
    kept = FN.apply_policy(
        _security(spark, sf),
        rules=[r.rule_id for r in C.SECURITY_RULES if r.rule_id != "CS-S006"],
        severity_threshold="medium", confidence_threshold=0.5,
        include_patterns=["*.py", "*.java", "*.js"], exclude_patterns=["src/src1/*", "f2?.py"],
    )
    return kept.select("file_id", "path", "rule_id", "severity", "line_start", "column_start")


C5_SQL = with_files("""
SELECT file_id, path, rule_id, severity, line_start, column_start FROM security_findings
WHERE rule_id NOT IN ('CS-S006', 'CS-AST001') AND severity IN ('critical', 'high', 'medium')
  AND confidence IN ('high', 'medium') AND regexp_matches(path, '[.](py|java|js)$')
  AND path NOT LIKE 'src/src1/%' AND NOT regexp_matches(path, '/f2.[.]py$')""", *SECURITY_CTES)


def e1(spark, sf):
    return FN.summary(_all(spark, sf))


E1_SQL = with_files("""
SELECT dimension, key, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'total' AS dimension, 'all' AS key, count(*) AS n FROM all_findings
  UNION ALL SELECT 'severity', severity, count(*) FROM all_findings GROUP BY severity
  UNION ALL SELECT 'type', finding_type, count(*) FROM all_findings GROUP BY finding_type
  UNION ALL SELECT * FROM (VALUES ('severity', 'high', 0), ('severity', 'medium', 0),
    ('severity', 'low', 0), ('severity', 'info', 0), ('type', 'security', 0),
    ('type', 'performance', 0), ('type', 'quality', 0)))
GROUP BY ALL""", *ALL_CTES)


def e1_maps(spark, sf):
    maps = FN.summary_maps(_all(spark, sf))
    return maps.select(
        "total_findings",
        F.coalesce(F.col("severity_counts")["critical"], F.lit(0)).alias("critical"),
        F.col("severity_counts")["info"].alias("info"),
        F.col("type_counts")["security"].alias("security"),
        F.col("type_counts")["quality"].alias("quality"),
    )


E1_MAPS_SQL = with_files("""SELECT count(*) AS total_findings,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'info') AS info,
  count(*) FILTER (finding_type = 'security') AS security,
  count(*) FILTER (finding_type = 'quality') AS quality FROM all_findings""", *ALL_CTES)


def e2(spark, sf):
    return FN.scan_summary(
        code_files(spark, sf), _security(spark, sf), len(C.SECURITY_RULES)
    )


E2_SQL = with_files(f"""
SELECT repo_id, files_scanned, files_analyzed, coalesce(findings_count, 0) AS findings_count,
  {len(C.SECURITY_RULES)} AS rules_applied
FROM (SELECT repo_id, count(*) AS files_scanned, count(language) AS files_analyzed FROM code_files
    GROUP BY repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS findings_count FROM security_findings GROUP BY repo_id)
  USING (repo_id)""", *SECURITY_CTES)


def _report(spark, sf):
    report = FN.security_report(_security(spark, sf))
    return report.select(
        "repo_id", "findings",
        F.concat_ws("|", "top_vulnerabilities").alias("top"),
        F.concat_ws("|", "remediation_priority").alias("priority"),
        F.coalesce(F.col("by_severity")["critical"], F.lit(0)).alias("critical"),
        F.coalesce(F.col("by_category")["A03"], F.lit(0)).alias("injection"),
        F.col("compliant_a01").cast("int").alias("a01"),
        F.col("compliant_a03").cast("int").alias("a03"),
    )


E5_SQL = with_files("""
SELECT repo_id, CAST(sum(n) AS BIGINT) AS findings,
  array_to_string(list(rule_id ORDER BY rank, n DESC, rule_id)[1:5], '|') AS top,
  array_to_string(list(suggestion ORDER BY rank, n DESC, rule_id) FILTER (first_use), '|') AS priority,
  CAST(coalesce(sum(n) FILTER (severity = 'critical'), 0) AS BIGINT) AS critical,
  CAST(coalesce(sum(n) FILTER (owasp_category = 'A03'), 0) AS BIGINT) AS injection,
  CASE WHEN count(*) FILTER (owasp_category = 'A01') = 0 THEN 1 ELSE 0 END AS a01,
  CASE WHEN count(*) FILTER (owasp_category = 'A03') = 0 THEN 1 ELSE 0 END AS a03
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, suggestion ORDER BY rank, n DESC, rule_id) = 1
    AS first_use FROM (SELECT repo_id, rule_id, severity, suggestion, owasp_category, count(*) AS n,
    CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS rank
  FROM security_findings GROUP BY ALL))
GROUP BY repo_id""", *SECURITY_CTES)


def e8(spark, sf):
    return FN.analysis_metrics(code_files(spark, sf), _security(spark, sf))


E8_SQL = with_files("""
SELECT repo_id, files_analyzed, lines_analyzed, coalesce(findings_total, 0) AS findings_total,
  coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
  coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_info, 0) AS n_info
FROM (SELECT repo_id, count(DISTINCT file_id) AS files_analyzed, count(*) AS lines_analyzed FROM lines
    GROUP BY repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS findings_total,
    count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high,
    count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low,
    count(*) FILTER (severity = 'info') AS n_info FROM security_findings GROUP BY repo_id)
  USING (repo_id)""", *SECURITY_CTES)


def e13(spark, sf):
    return FN.by_severity(_security(spark, sf))


E13_SQL = with_files("""SELECT severity, count(*) AS n, CASE severity WHEN 'critical' THEN 1
  WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS rank
FROM security_findings GROUP BY severity""", *SECURITY_CTES)


def g1(spark, sf):
    return FN.first_findings(_security(spark, sf)).select(
        "path", "line_start", "rule_id", F.coalesce("column_start", F.lit(-1)).alias("column_start")
    )


G1_SQL = with_files("""SELECT path, line_start, rule_id, coalesce(column_start, -1) AS column_start
FROM security_findings ORDER BY path, line_start, rule_id, column_start NULLS FIRST LIMIT 100""",
                    *SECURITY_CTES)


def g3(spark, sf):
    rows = _security(spark, sf).select("file_id", "line_start", "rule_id", "column_start")
    order = [F.col("file_id"), F.col("line_start"), F.col("rule_id"),
             F.col("column_start").asc_nulls_first()]
    return FN.page_at_once(rows, order, number=3, size=20).select("file_id", "line_start", "rule_id", "total")


G3_SQL = with_files("""SELECT file_id, line_start, rule_id,
  (SELECT count(*) FROM security_findings) AS total FROM security_findings
ORDER BY file_id, line_start, rule_id, column_start NULLS FIRST LIMIT 20 OFFSET 40""",
                    *SECURITY_CTES)


def k6(spark, sf):
    snippets = code_files(spark, sf).select(
        F.col("path").alias("filename"), "language", F.col("content").alias("code")
    )
    done = A.analyze_snippets(snippets)
    return done.select(
        "filename", F.coalesce("language", F.lit("-")).alias("language"), "lines_of_code",
        "findings_count", "status",
    )


K6_SQL = with_files("""
SELECT c.path AS filename, coalesce(c.language, '-') AS language,
  CAST(len(string_split(c.content, chr(10))) AS INT) AS lines_of_code,
  count(a.rule_id) AS findings_count, 'completed' AS status
FROM code_files c LEFT JOIN (SELECT * FROM all_findings WHERE finding_type <> 'taint') a USING (file_id)
GROUP BY c.file_id, c.path, c.language, c.content""", *ALL_CTES)


def c13(spark, sf):
    """Events read as findings: value as confidence, type as severity."""
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 100).alias("confidence"),
        F.when(F.col("event_type") == "error", "high").when(
            F.col("event_type") == "view", "info").otherwise("urgent").alias("severity"),
    )
    accepted, rejected = FN.validate(rows, FN.finding_constraints())
    return (
        rejected.select(F.array_join("failed", "+").alias("failed"))
        .unionByName(accepted.select(F.lit("accepted").alias("failed")))
        .groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    )


def c13_bounds(spark, sf):
    """Documents read as vulnerabilities, snippets and generation requests, by what fails."""
    n = F.col("n_chars")
    rows = table(spark, sf, "documents").select(
        (n % 110 / 100).alias("confidence"),
        F.when(n % 5 == 0, "urgent").otherwise("low").alias("severity"),
        F.when(n % 7 > 0, n % 120 / 10).alias("cvss"), F.col("text").alias("code"), "source",
        F.when(n % 4 > 0, F.col("lang")).alias("language"), F.col("text").alias("prompt"),
        (n % 5000).alias("max_tokens"), (n % 23 / 10).alias("temperature"),
        (n % 12 / 10).alias("top_p"), (n % 1010).alias("top_k"),
        (n % 13 / 5).alias("repetition_penalty"),
    )
    found = None
    for kind, rules in (("vulnerability", FN.vulnerability_constraints()),
                        ("snippet", FN.snippet_constraints()),
                        ("generation", FN.generation_constraints())):
        _, rejected = FN.validate(rows, rules)
        part = rejected.select(F.lit(kind).alias("kind"), F.explode("failed").alias("failed"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("kind", "failed").agg(F.count(F.lit(1)).alias("n"))


C13_BOUNDS_SQL = """WITH checks AS (SELECT unnest([
  {'kind': 'vulnerability', 'failed': 'confidence', 'ok': n_chars % 110 <= 100},
  {'kind': 'vulnerability', 'failed': 'severity', 'ok': n_chars % 5 <> 0},
  {'kind': 'vulnerability', 'failed': 'cvss', 'ok': n_chars % 7 = 0 OR n_chars % 120 <= 100},
  {'kind': 'snippet', 'failed': 'code', 'ok': length(text) BETWEEN 1 AND 100000},
  {'kind': 'snippet', 'failed': 'language', 'ok': n_chars % 4 > 0 AND lang IS NOT NULL},
  {'kind': 'generation', 'failed': 'prompt', 'ok': length(text) >= 1},
  {'kind': 'generation', 'failed': 'max_tokens', 'ok': n_chars % 5000 BETWEEN 1 AND 4096},
  {'kind': 'generation', 'failed': 'temperature', 'ok': n_chars % 23 <= 20},
  {'kind': 'generation', 'failed': 'top_p', 'ok': n_chars % 12 <= 10},
  {'kind': 'generation', 'failed': 'top_k', 'ok': n_chars % 1010 BETWEEN 1 AND 1000},
  {'kind': 'generation', 'failed': 'repetition_penalty', 'ok': n_chars % 13 BETWEEN 5 AND 10}]) AS c
  FROM documents)
SELECT c.kind AS kind, c.failed AS failed, count(*) AS n FROM checks
WHERE NOT coalesce(c.ok, false) GROUP BY ALL"""

C13_SQL = """SELECT failed, count(*) AS n FROM (SELECT CASE
    WHEN bad_c AND bad_s THEN 'confidence+severity' WHEN bad_c THEN 'confidence'
    WHEN bad_s THEN 'severity' ELSE 'accepted' END AS failed
  FROM (SELECT value / 100 < 0 OR value / 100 > 1 AS bad_c, event_type NOT IN ('error', 'view') AS bad_s
    FROM events)) GROUP BY failed"""

PATTERN_JSON = (
    "concat('{\"results\": [{\"check_id\": \"r', cast(event_id % 9 AS varchar(20)), "
    "'\", \"path\": \"f', cast(user_id AS varchar(20)), '.py\", \"start\": {\"line\": ', "
    "cast(event_id % 50 + 1 AS varchar(20)), '}, \"end\": {\"line\": ', "
    "cast(event_id % 50 + 2 AS varchar(20)), '}, \"extra\": {\"message\": \"', event_type, "
    "'\", \"severity\": \"', CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' "
    "WHEN 2 THEN 'INFO' ELSE 'X' END, '\", \"lines\": \"x\"}}]}')"
)
LINT_JSON = (
    "concat('{\"results\": [{\"test_id\": \"B', cast(event_id % 9 AS varchar(20)), "
    "'\", \"test_name\": \"', event_type, '\", \"issue_severity\": \"HIGH\", "
    "\"issue_confidence\": \"LOW\", \"issue_text\": \"t\", \"filename\": \"g', "
    "cast(user_id AS varchar(20)), '.py\", \"line_number\": ', "
    "cast(event_id % 50 + 1 AS varchar(20)), ', \"code\": \"y\", \"issue_cwe\": {\"id\": 78}}]}')"
)


def h5(spark, sf):
    events = table(spark, sf, "events")
    first = FN.pattern_report(
        events.select(F.from_json(F.expr(PATTERN_JSON), FN.PATTERN_REPORT).alias("r")).select("r.*")
    )
    second = FN.lint_report(
        events.select(F.from_json(F.expr(LINT_JSON), FN.LINT_REPORT).alias("r")).select("r.*")
    )
    return FN.union_findings(first, second).groupBy(
        "rule_id", "severity", "confidence", "message"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("line_end").alias("line_sum"))


H5_SQL = """SELECT rule_id, severity, confidence, message, count(*) AS n,
  CAST(sum(line_end) AS BIGINT) AS line_sum FROM (
  SELECT concat('r', event_id % 9) AS rule_id, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 2 THEN 'low'
    ELSE 'medium' END AS severity, 'medium' AS confidence, event_type AS message,
    event_id % 50 + 2 AS line_end FROM events
  UNION ALL SELECT concat('B', event_id % 9), 'high', 'low', 't', event_id % 50 + 1 FROM events)
GROUP BY ALL"""


# --- sinks and reports: written to the shared folder, then read back ------------


def a10(spark, sf):
    path = scratch_dir(spark, "findings")
    sinks.write_findings(_security(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("repo_id", "finding_type", "rule_id").agg(F.count(F.lit(1)).alias("n"))


A10_SQL = with_files("""SELECT repo_id, 'security' AS finding_type, rule_id, count(*) AS n
FROM security_findings GROUP BY ALL""", *SECURITY_CTES)


def a16(spark, sf):
    path = sinks.export_report(
        FN.security_report(_security(spark, sf)), scratch_dir(spark, "report"), "json"
    )
    schema = "repo_id string, findings bigint, top_vulnerabilities array<string>"
    return spark.read.schema(schema).json(path).select(
        "repo_id", "findings", F.concat_ws("|", "top_vulnerabilities").alias("top")
    )


A16_SQL = f"SELECT repo_id, findings, top FROM ({E5_SQL})"


# --- jobs and listings ------------------------------------------------------------


def _jobs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(
            F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("repo_id"),
        F.col("o_totalprice").alias("size"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
  o_orderdate AS created_at, o_orderpriority AS repo_id, o_totalprice AS size FROM orders)"""


def c4(spark, sf):
    return J.filter_status(_jobs(spark, sf), "queued").groupBy("priority").agg(
        F.count(F.lit(1)).alias("n")
    )


def c12(spark, sf):
    """Documents by the ids in labels and by ids that do not exist."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    requested = labels.unionByName(labels.select((F.col("id") + 100000000).alias("id")))
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return J.lookup(documents, requested).select(
        "id", F.coalesce("lang", F.lit("-")).alias("lang"), F.col("found").cast("int").alias("found")
    )


C12_SQL = """SELECT r.id, coalesce(lang, '-') AS lang, CASE WHEN lang IS NULL THEN 0 ELSE 1 END AS found
FROM (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id + 100000000 FROM labels) r
LEFT JOIN documents d ON d.doc_id = r.id"""


def e14(spark, sf):
    return J.progress(_jobs(spark, sf), "repo_id")


E14_SQL = f"""WITH {JOBS} SELECT repo_id, count(*) AS total_files,
  count(*) FILTER (status = 'completed') AS analyzed_files,
  CAST(floor(count(*) FILTER (status = 'completed') * 100 / count(*)) AS INT) AS percentage
FROM jobs GROUP BY repo_id"""


def g4(spark, sf):
    order = [F.desc("created_at"), F.asc("id")]
    return FN.page_at_once(_jobs(spark, sf), order, number=2, size=50).select("id", "status", "total")


def g5(spark, sf):
    """Head of the queue: the next hundred jobs to run."""
    return J.by_priority(J.filter_status(_jobs(spark, sf), "queued")).limit(100).select(
        "id", "priority"
    )


QUERIES = {
    "l1_findings_by_category": (l1, L1_SQL),
    "h1_findings_union": (h1, H1_SQL),
    "c2_filter_findings": (c2, C2_SQL),
    "c3_rule_listing": (c3, C3_SQL),
    "c4_status_filter": (c4, f"WITH {JOBS} SELECT priority, count(*) AS n FROM jobs"
                             " WHERE status = 'queued' GROUP BY priority"),
    "c5_policy": (c5, C5_SQL),
    "c10_analysis_selection": (c10, C10_SQL),
    "c12_point_lookup": (c12, C12_SQL),
    "c13_validation": (c13, C13_SQL),
    "c13_record_bounds": (c13_bounds, C13_BOUNDS_SQL),
    "e1_finding_summary": (e1, E1_SQL),
    "e1_summary_maps": (e1_maps, E1_MAPS_SQL),
    "e2_scan_summary": (e2, E2_SQL),
    "e5_security_report": (_report, E5_SQL),
    "e8_analysis_metrics": (e8, E8_SQL),
    "e13_by_severity": (e13, E13_SQL),
    "e14_progress": (e14, E14_SQL),
    "g1_first_findings": (g1, G1_SQL),
    "g3_page_with_total": (g3, G3_SQL),
    "g4_newest_first": (g4, f"WITH {JOBS} SELECT id, status, (SELECT count(*) FROM jobs) AS total"
                            " FROM jobs ORDER BY created_at DESC, id LIMIT 50 OFFSET 50"),
    "g5_job_order": (g5, f"WITH {JOBS} SELECT id, priority FROM jobs WHERE status = 'queued'"
                         " ORDER BY priority, created_at, id LIMIT 100"),
    "h5_external_reports": (h5, H5_SQL),
    "k6_snippet_batch": (k6, K6_SQL),
    "a10_findings_sink": (a10, A10_SQL),
    "a16_report_export": (a16, A16_SQL),
}
