"""Whole analyses put together from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..functions.bind import built_once, struct_of
from ..operators import findings as FN
from ..operators import metrics, rules, structure, taint


FUNCTION_FINDING = (
    "array<struct<finding_type:string,rule_id:string,rule_name:string,severity:string,"
    "confidence:string,message:string,line_start:int,line_end:int,code_snippet:string,"
    "suggestion:string,expected_improvement:string,complexity_score:double,cwe_id:string,"
    "owasp_category:string>>"
)


def _dangerous() -> Column:
    return F.array_compact(
        F.array(
            F.when(
                structure.is_dangerous(),
                struct_of(
                    finding_type=F.lit("security"), rule_id=F.lit("CS-AST001"),
                    rule_name=F.lit("Dangerous Function Usage"), severity=F.lit("high"),
                    confidence=F.lit("medium"),
                    message=F.format_string(
                        "Potentially dangerous function '%s' detected", "name"),
                    line_start=F.col("start_line"), line_end=F.col("end_line"),
                    code_snippet=F.lit(None), suggestion=F.lit(structure.DANGEROUS_ADVICE),
                    expected_improvement=F.lit(None), complexity_score=F.lit(None),
                    cwe_id=F.lit("CWE-94"), owasp_category=F.lit("A03"),
                ),
            )
        )
    ).cast(FUNCTION_FINDING)


def _thresholds() -> Column:
    found = metrics.threshold_array(F.col("complexity"), F.col("end_line") - F.col("start_line"))
    return F.transform(
        found,
        lambda f: struct_of(
            finding_type=F.lit("performance"), rule_id=f["rule_id"], rule_name=f["rule_name"],
            severity=f["severity"], confidence=F.lit(None), message=f["message"],
            line_start=F.col("start_line"), line_end=F.col("end_line"), code_snippet=F.lit(None),
            suggestion=f["suggestion"], expected_improvement=f["expected_improvement"],
            complexity_score=f["complexity_score"], cwe_id=F.lit(None),
            owasp_category=F.lit(None),
        ),
    ).cast(FUNCTION_FINDING)


def _inner_imports() -> Column:
    return F.transform(
        "imports",
        lambda i: struct_of(
            finding_type=F.lit("performance"), rule_id=F.lit("PERF-P006"),
            rule_name=F.lit("Import Inside Function"), severity=F.lit("low"),
            confidence=F.lit(None),
            message=F.format_string("Import statement inside function '%s'", "name"),
            line_start=i["line_no"], line_end=i["line_no"], code_snippet=i["text"],
            suggestion=F.lit(structure.IMPORT_ADVICE), expected_improvement=F.lit(None),
            complexity_score=F.lit(None), cwe_id=F.lit(None), owasp_category=F.lit(None),
        ),
    ).cast(FUNCTION_FINDING)


@built_once
def _function_findings(types: tuple[str, ...]) -> Column:
    parts = {
        "security": lambda: _dangerous(),
        "performance": lambda: F.concat(_thresholds(), _inner_imports()),
    }
    return F.concat(*[parts[t]() for t in types])


def function_findings(files: DataFrame, types: Sequence[str]) -> DataFrame:
    """Findings that concern functions, all from one parse of each file."""
    keys = [c for c in rules.KEYS if c in files.columns]
    return structure.functions_with_imports(files).select(
        *keys, F.inline(_function_findings(tuple(types)))
    )


LINE_RULES = {"security": C.SECURITY_RULES, "performance": C.PERFORMANCE_RULES}


def security_findings(files: DataFrame) -> DataFrame:
    """Rule matches and dangerous definitions."""
    return analyze(files, ["security"])


def performance_findings(files: DataFrame) -> DataFrame:
    """Function thresholds, line patterns and imports inside functions."""
    return analyze(files, ["performance"])


def taint_findings(files: DataFrame) -> DataFrame:
    return taint.taint_findings(taint.vulnerable_flows(files))


ANALYSES = {
    "security": security_findings,
    "performance": performance_findings,
    "taint": taint_findings,
}


def analyze(
    files: DataFrame, types: Sequence[str] = ("security", "performance", "taint")
) -> DataFrame:
    """Findings of the requested analyses over a table of files.

    Three narrow passes at most, whatever is asked for: lines, functions and
    flows.  Nothing is shuffled until the caller aggregates or writes.
    "comprehensive" stands for all of them.
    """
    wanted = list(ANALYSES) if "comprehensive" in types else [t for t in types if t in ANALYSES]
    if not wanted:
        raise ValueError(f"analysis types are {sorted(ANALYSES)} or comprehensive")
    by_line = [t for t in LINE_RULES if t in wanted]
    parts = []
    if by_line:
        catalog = tuple(rule for t in by_line for rule in LINE_RULES[t])
        parts = [rules.scan(files, catalog), function_findings(files, by_line)]
    if "taint" in wanted:
        parts.append(taint_findings(files))
    return FN.union_findings(*parts)


def analyze_snippets(
    snippets: DataFrame, types: Sequence[str] = ("security", "performance")
) -> DataFrame:
    """One result row per snippet (filename, code, language).

    Snippets have no id, so equal ones share one: their findings are counted
    together and divided by the number of copies.
    """
    files = snippets.select(
        F.xxhash64("filename", "language", "code").alias("file_id"),
        F.lit("").alias("repo_id"),
        F.col("filename").alias("path"),
        "language",
        F.col("code").alias("content"),
    )
    found = analyze(files, types).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    copies = files.groupBy("file_id").agg(F.count(F.lit(1)).alias("copies"))
    counts = copies.join(found, "file_id", "left").select(
        "file_id", F.floor(F.coalesce("n", F.lit(0)) / F.col("copies")).alias("findings_count")
    )
    return (
        files.select("file_id", F.col("path").alias("filename"), "language",
                     F.size(X.split_lines(F.col("content"))).alias("lines_of_code"))
        .join(counts, "file_id")
        .select(
            "filename", "language", "lines_of_code", "findings_count",
            F.lit("completed").alias("status"),
        )
    )


def findings_by_category(files: DataFrame) -> DataFrame:
    """Security findings by language, severity and OWASP category."""
    found = security_findings(files)
    category = F.coalesce("owasp_category", F.lit("unmapped"))
    return (
        found.groupBy("language", "severity", category.alias("category"))
        .agg(
            F.count(F.lit(1)).alias("n_findings"),
            F.count_if(F.col("confidence") == "high").alias("n_certain"),
            F.min("line_start").alias("first_line"),
        )
        .withColumn("title", F.coalesce(rules.owasp_title(F.col("category")), F.lit("Unmapped")))
    )
