"""The findings table: union, filters, summaries, reports, paging."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from .rules import owasp_of

# Total order of findings, for every listing that is cut.
ORDER = ("path", "line_start", "rule_id", "column_start", "message")


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union of scanner outputs; columns a scanner lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def filter_findings(
    findings: DataFrame, severity: str | None = None, finding_type: str | None = None
) -> DataFrame:
    if severity:
        findings = findings.filter(F.col("severity") == severity)
    if finding_type:
        findings = findings.filter(F.col("finding_type") == finding_type)
    return findings


def select_analyses(outputs: dict[str, DataFrame], types: Sequence[str]) -> DataFrame:
    """Union of the requested analyses only; the others are never planned."""
    chosen = [outputs[t] for t in types if t in outputs]
    if not chosen:
        raise ValueError(f"no analysis among {sorted(outputs)} was requested")
    return union_findings(*chosen)


# --- policy -------------------------------------------------------------------

# Numeric value of a textual confidence, for thresholds.
CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.3}


def confidence_value(confidence: Column) -> Column:
    """0..1 from text; findings without a confidence count as certain."""
    expr = F.when(confidence.isNull(), F.lit(1.0))
    for k, v in CONFIDENCE.items():
        expr = expr.when(confidence == k, F.lit(v))
    return expr.otherwise(F.lit(0.0))


def glob_regex(pattern: str) -> str:
    """Regex of a path glob matched from the right, '*' staying in one part."""
    body = "".join(
        "[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in pattern
    )
    return ("^" if pattern.startswith("/") else "(?:^|/)") + body + "$"


def apply_policy(
    findings: DataFrame,
    rules: Sequence[str] = (),
    severity_threshold: str = "low",
    confidence_threshold: float = 0.5,
    include_patterns: Sequence[str] = (),
    exclude_patterns: Sequence[str] = (),
) -> DataFrame:
    """Keep what a policy reports: rules, severity, confidence and paths."""
    rank = list(C.SEVERITIES).index(severity_threshold) + 1
    kept = findings.filter(X.severity_rank(F.col("severity")).between(1, rank)).filter(
        confidence_value(F.col("confidence")) >= confidence_threshold
    )
    if rules:
        kept = kept.filter(F.col("rule_id").isin(*rules))
    if include_patterns:
        kept = kept.filter(F.rlike("path", F.lit("|".join(map(glob_regex, include_patterns)))))
    if exclude_patterns:
        kept = kept.filter(~F.rlike("path", F.lit("|".join(map(glob_regex, exclude_patterns)))))
    return kept


def filter_rules(rules: DataFrame, category: str | None, language: str | None) -> DataFrame:
    """Rule listing by category and by language, '*' covering all languages."""
    if category:
        rules = rules.filter(F.col("category") == category)
    if language:
        rules = rules.filter(
            F.array_contains("languages", language) | F.array_contains("languages", "*")
        )
    return rules


def listed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, b, c, list(d), e, f) for a, b, c, d, e, f in C.LISTED_RULES],
        "id string, name string, category string, languages array<string>, "
        "severity string, description string",
    )


# --- validation ---------------------------------------------------------------


def validate(df: DataFrame, constraints: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into accepted rows and rejected rows with the names that failed.

    A constraint that is NULL for a row counts as failed.
    """
    failed = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(test, F.lit(False)), F.lit(name))
                for name, test in constraints.items()
            ]
        )
    )
    checked = df.withColumn("failed", failed)
    return (
        checked.filter(F.size("failed") == 0).drop("failed"),
        checked.filter(F.size("failed") > 0),
    )


# Constraints of the input records.
def finding_constraints() -> dict[str, Column]:
    return {
        "confidence": F.col("confidence").between(0, 1),
        "severity": F.col("severity").isin(*C.SEVERITIES),
    }


def vulnerability_constraints() -> dict[str, Column]:
    """A score may be missing, but not out of range."""
    return finding_constraints() | {
        "cvss": F.col("cvss").isNull() | F.col("cvss").between(0, 10),
    }


def snippet_constraints() -> dict[str, Column]:
    return {
        "code": F.length("code").between(1, 100000),
        "language": F.col("language").isNotNull(),
    }


def generation_constraints() -> dict[str, Column]:
    return {
        "prompt": F.length("prompt") >= 1,
        "max_tokens": F.col("max_tokens").between(1, 4096),
        "temperature": F.col("temperature").between(0, 2),
        "top_p": F.col("top_p").between(0, 1),
        "top_k": F.col("top_k").between(1, 1000),
        "repetition_penalty": F.col("repetition_penalty").between(1, 2),
    }


# --- summaries ----------------------------------------------------------------


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and by type in long form, default keys zero-filled.

    One aggregation: counts are partial per task and at most a few keys wide
    after it.
    """
    spark = findings.sparkSession
    domain = spark.createDataFrame(
        [("total", "all")]
        + [("severity", s) for s in C.SUMMARY_SEVERITIES]
        + [("type", t) for t in C.SUMMARY_TYPES],
        "dimension string, key string",
    ).withColumn("n", F.lit(0).cast("bigint"))
    counted = findings.groupBy("severity", "finding_type").agg(F.count(F.lit(1)).alias("c"))
    long = counted.select(
        F.inline(
            F.array(
                F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("key")),
                F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("key")),
                F.struct(F.lit("type").alias("dimension"), F.col("finding_type").alias("key")),
            )
        ),
        F.col("c").alias("n"),
    )
    return long.unionByName(domain).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def summary_maps(findings: DataFrame) -> DataFrame:
    """The summary as one row: total and two maps."""
    rows = summary(findings)
    return rows.agg(
        F.sum(F.when(F.col("dimension") == "total", F.col("n")).otherwise(0)).alias(
            "total_findings"
        ),
        F.map_from_entries(
            F.collect_list(F.when(F.col("dimension") == "severity", F.struct("key", "n")))
        ).alias("severity_counts"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("dimension") == "type", F.struct("key", "n")))
        ).alias("type_counts"),
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """Groups in fixed severity order; groups without findings do not appear."""
    return (
        findings.filter(F.col("severity").isin(*C.SEVERITIES))
        .groupBy("severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rank", X.severity_rank(F.col("severity")))
        .orderBy("rank")
    )


def scan_summary(files: DataFrame, findings: DataFrame, rules_applied: int) -> DataFrame:
    """Per repository: files scanned, findings and rules applied.

    Files are unique rows, so a plain count does; no distinct is needed.
    """
    scanned = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.col("language").isNotNull()).alias("files_analyzed"),
    )
    found = findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings_count"))
    return (
        scanned.join(found, "repo_id", "left")
        .withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))
        .withColumn("rules_applied", F.lit(rules_applied))
    )


def analysis_metrics(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository: files, lines, findings, and findings by severity."""
    size = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1)
        .alias("lines_analyzed"),
    )
    counts = findings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("findings_total"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in C.SEVERITIES],
    )
    return size.join(counts, "repo_id", "left").na.fill(0)


def security_report(findings: DataFrame, top: int = 5) -> DataFrame:
    """One report row per repository.

    Findings are first reduced to one row per repository and rule, which a
    catalog bounds; lists are only ever collected from those rows.
    """
    category = owasp_of(F.col("cwe_id"))
    by_rule = findings.groupBy("repo_id", "rule_id", "severity", "suggestion", "cwe_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = by_rule.withColumn("category", F.coalesce(category, F.lit("other"))).withColumn(
        "rank", X.severity_rank(F.col("severity"))
    )
    entry = F.struct(
        "rank", (-F.col("n")).alias("minus_n"), "rule_id", "suggestion", "severity", "category", "n"
    )
    lists = ranked.groupBy("repo_id").agg(
        F.sum("n").alias("findings"),
        F.array_sort(F.collect_list(entry)).alias("__rules"),
        *[
            (F.count_if(F.col("category") == code) == 0).alias(f"compliant_{code.lower()}")
            for code in C.OWASP_TITLES
        ],
    )
    return lists.select(
        *[c for c in lists.columns if c != "__rules"],
        _counts("severity").alias("by_severity"),
        _counts("category").alias("by_category"),
        F.transform(F.slice("__rules", 1, top), lambda r: r["rule_id"]).alias(
            "top_vulnerabilities"
        ),
        F.array_distinct(F.transform("__rules", lambda r: r["suggestion"])).alias(
            "remediation_priority"
        ),
    )


def _counts(field: str) -> Column:
    """Map of a field's values to findings, from the few rule rows of a report."""
    values = F.array_distinct(F.transform("__rules", lambda r: r[field]))
    total = lambda v: F.aggregate(
        F.filter("__rules", lambda r: r[field] == v), F.lit(0).cast("bigint"),
        lambda acc, r: acc + r["n"],
    )
    return F.map_from_entries(
        F.transform(values, lambda v: F.struct(v.alias("key"), total(v).alias("n")))
    )


# --- listings -----------------------------------------------------------------


def first_findings(findings: DataFrame, limit: int = 100) -> DataFrame:
    """The first findings in path order: a top-k, not a sort of everything."""
    keys = [F.col(c).asc_nulls_first() for c in ORDER if c in findings.columns]
    return findings.orderBy(*keys).limit(limit)


def page(
    df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20
) -> DataFrame:
    """One page of a totally ordered listing, with the total on every row.

    offset+limit runs as a top-k; the total is a separate count, so no window
    pulls the table into one task.
    """
    _check_page(number, size)
    total = df.groupBy().agg(F.count(F.lit(1)).alias("total"))
    return (
        df.orderBy(*order)
        .offset((number - 1) * size)
        .limit(size)
        .withColumn("total", total.scalar())
    )


def page_at_once(
    df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20
) -> DataFrame:
    """Like page, but runs at once and computes ``df`` a single time.

    The total is observed in the pass that finds the page's rows, of which at most 100 come
    to the driver.
    """
    _check_page(number, size)
    seen = Observation()
    # After an explode the row count is unknown when planning: a limit that looked needless would
    # go, and the range sort in its place reads (and counts) the rows once more for its bounds.
    rows = (
        df.withColumn("__one", F.explode(F.array(F.lit(True))))
        .drop("__one")
        .observe(seen, F.count(F.lit(1)).alias("total"))
        .orderBy(*order)
        .offset((number - 1) * size)
        .limit(size)
    )
    found = rows.collect()
    return df.sparkSession.createDataFrame(found, rows.schema).withColumn(
        "total", F.lit(seen.get["total"] if found else 0).cast("bigint"))


def _check_page(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and holds 1 to 100 rows")


# --- external reports -----------------------------------------------------------

PATTERN_REPORT = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,"
    "end:struct<line:int>,extra:struct<message:string,severity:string,lines:string>>>"
)
LINT_REPORT = (
    "results array<struct<test_id:string,test_name:string,issue_severity:string,"
    "issue_confidence:string,issue_text:string,filename:string,line_number:int,code:string,"
    "issue_cwe:struct<id:int,link:string>>>"
)


def pattern_report(reports: DataFrame) -> DataFrame:
    """Findings of a pattern scanner's report (check_id / extra layout)."""
    return reports.select(F.inline("results")).select(
        F.lit("security").alias("finding_type"),
        F.coalesce("check_id", F.lit("unknown")).alias("rule_id"),
        F.coalesce("extra.message", F.lit("Unknown")).alias("rule_name"),
        X.external_severity(F.coalesce("extra.severity", F.lit("WARNING"))).alias("severity"),
        F.lit("medium").alias("confidence"),
        F.coalesce("extra.message", F.lit("")).alias("message"),
        "path",
        F.coalesce("start.line", F.lit(0)).alias("line_start"),
        F.coalesce("end.line", F.lit(0)).alias("line_end"),
        F.coalesce("extra.lines", F.lit("")).alias("code_snippet"),
    )


def lint_report(reports: DataFrame) -> DataFrame:
    """Findings of a lint report (test_id / issue_* layout)."""
    return reports.select(F.inline("results")).select(
        F.lit("security").alias("finding_type"),
        F.coalesce("test_id", F.lit("B000")).alias("rule_id"),
        F.coalesce("test_name", F.lit("Unknown")).alias("rule_name"),
        F.lower(F.coalesce("issue_severity", F.lit("LOW"))).alias("severity"),
        F.lower(F.coalesce("issue_confidence", F.lit("MEDIUM"))).alias("confidence"),
        F.coalesce("issue_text", F.lit("")).alias("message"),
        F.col("filename").alias("path"),
        F.coalesce("line_number", F.lit(0)).alias("line_start"),
        F.coalesce("line_number", F.lit(0)).alias("line_end"),
        F.coalesce("code", F.lit("")).alias("code_snippet"),
        F.concat(F.lit("CWE-"), F.col("issue_cwe.id").cast("string")).alias("cwe_id"),
    )
