"""Function metrics and the findings derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalogs as C
from .rules import KEYS


def maintainability(loc: Column, complexity: Column) -> Column:
    """Index 0..171 from length and complexity, 100 for an empty span."""
    raw = (
        F.lit(171.0)
        - F.lit(5.2) * F.ln(loc * 10)
        - F.lit(0.23) * complexity
        - F.lit(16.2) * F.ln(loc)
    )
    return F.when(loc > 0, F.round(F.greatest(F.lit(0.0), raw), 2)).otherwise(F.lit(100.0))


def nesting(complexity: Column) -> Column:
    """Nesting estimate from complexity, at most 10."""
    return F.least(F.floor(complexity / 3), F.lit(10)).cast("int")


def function_metrics(functions: DataFrame) -> DataFrame:
    """Metrics per function row; cognitive complexity equals cyclomatic."""
    keys = [c for c in KEYS if c in functions.columns]
    loc = F.col("end_line") - F.col("start_line")
    return functions.select(
        *keys, "name", "start_line", "end_line",
        F.col("complexity").alias("cyclomatic"),
        F.col("complexity").alias("cognitive"),
        loc.alias("loc"),
        (loc * 10).cast("double").alias("volume"),
        (F.col("complexity") * 0.5).cast("double").alias("difficulty"),
        maintainability(loc, F.col("complexity")).alias("maintainability"),
    )


def last_by_name(metrics: DataFrame) -> DataFrame:
    """One row per file and function name: the last definition wins."""
    w = W.partitionBy("file_id", "name").orderBy(F.desc("start_line"), F.desc("end_line"))
    return metrics.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def hot_paths(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The k most complex functions of each file, after last_by_name."""
    w = W.partitionBy("file_id").orderBy(F.desc("cyclomatic"), "name")
    return (
        last_by_name(metrics)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def finding(
    rule: str, title: str, severity: str, message: Column, advice: str,
    expected: str | None = None, score: Column | None = None,
) -> Column:
    """Fields of a finding that concerns a whole function."""
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(title).alias("rule_name"),
        F.lit(severity).alias("severity"), message.alias("message"),
        F.lit(advice).alias("suggestion"),
        F.lit(expected).cast("string").alias("expected_improvement"),
        (F.lit(None) if score is None else score).cast("double").alias("complexity_score"),
    )


def threshold_array(
    complexity: Column,
    span: Column,
    high: int = C.COMPLEXITY_HIGH,
    medium: int = C.COMPLEXITY_MEDIUM,
    max_span: int = C.MAX_FUNCTION_SPAN,
    max_nesting: int = C.MAX_NESTING,
) -> Column:
    """Up to three findings of a function row with a ``name``."""
    name, deep = F.col("name"), nesting(complexity)
    complex_ = F.when(
        complexity > high,
        finding(
            "PERF-C001", "Very High Cyclomatic Complexity", "high",
            F.format_string(
                "Function '%s' has very high cyclomatic complexity (%d)", name, complexity),
            "Refactor the function into smaller, more manageable functions",
            "Improved testability and maintainability", complexity,
        ),
    ).when(
        complexity > medium,
        finding(
            "PERF-C002", "High Cyclomatic Complexity", "medium",
            F.format_string("Function '%s' has high cyclomatic complexity (%d)", name, complexity),
            "Consider simplifying the function logic", None, complexity,
        ),
    )
    long_ = F.when(
        span > max_span,
        finding(
            "PERF-S001", "Very Long Function", "medium",
            F.format_string("Function '%s' is very long (%d lines)", name, span),
            "Break the function into smaller functions",
            "Better readability and maintainability",
        ),
    )
    nested = F.when(
        deep > max_nesting,
        finding(
            "PERF-N001", "Deep Nesting", "medium",
            F.format_string("Function '%s' has deep nesting (level %d)", name, deep),
            "Consider extracting nested logic into separate functions",
        ),
    )
    return F.array_compact(F.array(complex_, long_, nested))


def threshold_findings(
    metrics: DataFrame,
    high: int = C.COMPLEXITY_HIGH,
    medium: int = C.COMPLEXITY_MEDIUM,
    max_span: int = C.MAX_FUNCTION_SPAN,
    max_nesting: int = C.MAX_NESTING,
) -> DataFrame:
    """PERF-C001/C002/S001/N001: up to three findings per function."""
    keys = [c for c in KEYS if c in metrics.columns]
    found = threshold_array(
        F.col("cyclomatic"), F.col("loc"), high, medium, max_span, max_nesting
    )
    return metrics.withColumn("__f", F.explode(found)).select(
        F.lit("performance").alias("finding_type"),
        "__f.rule_id", "__f.rule_name", "__f.severity", "__f.message",
        *keys,
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
        "__f.suggestion", "__f.expected_improvement", "__f.complexity_score",
    )
