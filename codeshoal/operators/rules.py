"""Line-level rule scans.

A catalog is unrolled into one expression: per line, an array of the rules
that match.  Each pattern is a literal, so it is compiled once per task, and a
scan is one pass over the files with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..functions.bind import built_once

KEYS = ("file_id", "repo_id", "path", "language")
# Rules of one expression; more of them go through an automaton, and those that cannot are tried
# in groups of so many in the same row.
RULE_GROUP = 200


def explode_lines(files: DataFrame, lookahead: int = 0, keep: Sequence[str] = KEYS) -> DataFrame:
    """One row per line: (keys..., line_no, line[, next1, next2]).

    The following lines are zipped in before the explode, so windows of two or
    three lines need no sort and no shuffle.
    """
    columns = [F.col(c) for c in keep if c in files.columns]
    lines = X.split_lines(F.col("content"))
    if not lookahead:
        return files.select(*columns, F.posexplode(lines).alias("__pos", "line")).select(
            *columns, (F.col("__pos") + 1).alias("line_no"), "line"
        )
    shifted = [F.col("__lines").alias("line")] + [
        F.slice(F.col("__lines"), n + 1, F.greatest(F.size("__lines") - n, F.lit(0)))
        .alias(f"next{n}")
        for n in range(1, lookahead + 1)
    ]
    return (
        files.select(*columns, lines.alias("__lines"))
        .select(*columns, F.posexplode(F.arrays_zip(*shifted)).alias("__pos", "__row"))
        .select(*columns, (F.col("__pos") + 1).alias("line_no"), "__row.*")
    )


def applies(rule: C.LineRule, language: Column) -> Column:
    """A rule for '*' applies to every known language."""
    if "*" in rule.languages:
        return language.isNotNull()
    return language.isin(*rule.languages)


def _window_text(size: int) -> Column:
    parts = [F.col("line")] + [F.col(f"next{n}") for n in range(1, size)]
    # concat, not concat_ws: without a following line there is no window.
    return reduce(lambda a, b: F.concat(a, F.lit("\n"), b), parts)


def _regex(rule: C.LineRule) -> str:
    # U also makes case folding Unicode-aware.
    return ("(?iudU)" if rule.kind == "security" else "(?dU)") + rule.pattern


def _hits(rule: C.LineRule) -> Column:
    """Cheapest test first: language, then literal, then regex."""
    language, line = F.col("language"), F.col("line")
    text = _window_text(rule.window) if rule.window > 1 else line
    regex = F.rlike(text, F.lit(_regex(rule)))
    return applies(rule, language) & line.contains(rule.gate) & regex


@built_once
def _constant(rules: tuple[C.LineRule, ...], field: str) -> Column:
    """CASE rule_id WHEN ... over a catalog field."""
    expr = None if rules else F.lit(None).cast("string")
    for rule in rules:
        value = F.lit(getattr(rule, field)).cast("string")
        cond = F.col("rule_id") == rule.rule_id
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


@built_once
def _matched(rules: tuple[C.LineRule, ...]) -> Column:
    return F.array_compact(
        F.array(*[F.when(_hits(rule), F.lit(rule.rule_id)) for rule in rules])
    )


def matching_lines(files: DataFrame, rules: Sequence[C.LineRule]) -> DataFrame:
    """(keys..., line_no, line, rule_id): one row per line and matching rule."""
    lookahead = max((rule.window for rule in rules), default=1) - 1
    lines = explode_lines(files.filter(F.col("language").isNotNull()), lookahead)
    groups = [tuple(rules[i:i + RULE_GROUP]) for i in range(0, len(rules), RULE_GROUP)]
    matched = F.concat(*map(_matched, groups)) if groups else F.array().cast("array<string>")
    return (
        lines.withColumn("__rules", matched)
        .filter(F.size("__rules") > 0)
        .withColumn("rule_id", F.explode("__rules"))
        .drop("__rules", "next1", "next2")
    )


@built_once
def _spans(rules: tuple[C.LineRule, ...]) -> Column:
    """Spans (begin, end) of every match of the row's rule, 0-based.

    The pieces between matches and the matches themselves alternate, so a fold
    over their lengths gives each position.
    """
    pieces = gaps = None
    for rule in rules:
        if rule.kind != "security":
            continue
        cond = F.col("rule_id") == rule.rule_id
        found = F.regexp_extract_all(F.col("line"), F.lit(_regex(rule)), 0)
        between = F.split(F.col("line"), _regex(rule), -1)
        pieces = F.when(cond, found) if pieces is None else pieces.when(cond, found)
        gaps = F.when(cond, between) if gaps is None else gaps.when(cond, between)
    if pieces is None:
        return F.array(F.struct(F.lit(None).alias("begin"), F.lit(None).alias("end"))).cast(SPANS)
    return _fold_spans(pieces, gaps)


SPANS = "array<struct<begin:int,end:int>>"


def _fold_spans(pieces: Column, gaps: Column) -> Column:
    """Spans of matches from the matches and the texts between; one empty span for no pieces."""
    once = F.array(F.struct(F.lit(None).alias("begin"), F.lit(None).alias("end"))).cast(SPANS)
    lengths = F.zip_with(
        gaps, pieces,
        lambda gap, hit: F.struct(
            F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(-1)).alias("hit")
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, item: Column) -> Column:
        begin = state["at"] + item["gap"]
        end = begin + F.greatest(item["hit"], F.lit(0))
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(item["hit"] >= 0, F.concat(state["spans"], span))
            .otherwise(state["spans"]).alias("spans"),
        )

    return F.coalesce(F.aggregate(lengths, start, step, lambda state: state["spans"]), once)


def scan(files: DataFrame, rules: Sequence[C.LineRule]) -> DataFrame:
    """Findings of any mix of line rules, in one pass over the files.

    More than RULE_GROUP rules go through an automaton (``scan_many``), with the same rows.
    """
    rules = tuple(rules)
    return scan_many(files, rules) if len(rules) > RULE_GROUP else _scan_unrolled(files, rules)


def _scan_unrolled(files: DataFrame, rules: tuple[C.LineRule, ...]) -> DataFrame:
    constant = lambda field: _constant(rules, field)
    return (
        matching_lines(files, rules)
        .withColumn("__span", F.explode(_spans(rules)))
        .select(
            constant("kind").alias("finding_type"),
            "rule_id",
            constant("name").alias("rule_name"),
            constant("severity").alias("severity"),
            constant("confidence").alias("confidence"),
            constant("message").alias("message"),
            *[c for c in KEYS if c in files.columns],
            F.col("line_no").alias("line_start"),
            F.col("line_no").alias("line_end"),
            F.col("__span.begin").alias("column_start"),
            F.col("__span.end").alias("column_end"),
            X.strip(F.col("line")).alias("code_snippet"),
            constant("remediation").alias("suggestion"),
            constant("cwe_id").alias("cwe_id"),
            owasp_of(constant("cwe_id")).alias("owasp_category"),
        )
    )


# --- thousands of rules ---------------------------------------------------------

# Escapes that stand for a class, a place or a control character, and nothing else.
_CLASS_ESCAPES = frozenset("wWdDsSbBAzZGRhHvVntrfea")
# The letters outside ASCII that equal one of a to z when case is ignored, and those.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")
LEAST_LITERAL = 3


def required_literal(pattern: str) -> str:
    """Longest text, in lower case, that is in every match of a pattern; "" if none is certain.

    Only ASCII text outside groups and classes counts.  Anything unusual (alternatives,
    flags, quoted parts, numbered characters, nested classes) gives "", which is always right.
    """
    runs, run, at = [], "", 0

    def skip_class(at: int) -> int | None:
        end = at + 1 + pattern.startswith("^", at + 1)
        if pattern.startswith("]", end):
            return None
        while end < len(pattern) and pattern[end] != "]":
            if pattern[end] == "[" or pattern.startswith("&&", end) or pattern.startswith("\\Q", end):
                return None
            end += 1 + (pattern[end] == "\\")
        return end if end < len(pattern) else None

    depth = 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            escaped = pattern[at + 1:at + 2]
            if escaped.isalnum() and escaped not in _CLASS_ESCAPES or not escaped.isascii():
                return ""
            at += 1
            char = "" if escaped.isalnum() else escaped
        elif char == "[":
            end = skip_class(at)
            if end is None:
                return ""
            at, char = end, ""
        elif char == "(":
            if pattern.startswith("(?", at) and pattern[at + 2:at + 3] not in tuple(":=!<>"):
                return ""
            # Of "(?:", only the mark itself is left out; the group's own text does not count.
            at += 1 if pattern.startswith("(?", at) else 0
            depth, char = depth + 1, ""
        elif char == ")":
            depth, char = depth - 1, ""
        elif char == "|":
            if depth == 0:
                return ""
            char = ""
        elif char in "?*{":
            # The character before may be missing; the text before it stays.
            runs.append(run[:-1])
            run, char = "", ""
            if pattern[at] == "{":
                end = pattern.find("}", at)
                if end < 0:
                    return ""
                at = end
        elif char in ".^$+" or not char.isascii() or not char.isprintable():
            char = ""
        if char and depth == 0:
            run += char
        elif not char:
            runs.append(run)
            run = ""
        at += 1
    return max([*runs, run], key=len).lower() if depth == 0 else ""


def _literals_in(literals: tuple[str, ...]):
    """Column function: numbers of the literals that a text contains, each once."""
    held: list = []

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        if not held:
            import ahocorasick

            numbers: dict[str, list[int]] = {}
            for number, literal in enumerate(literals):
                numbers.setdefault(literal, []).append(number)
            machine = ahocorasick.Automaton()
            for literal, own in numbers.items():
                machine.add_word(literal, own)
            machine.make_automaton()
            held.append(machine)
        return texts.map(
            lambda text: sorted({n for _, own in held[0].iter(text) for n in own}) if text else [])

    return find


def scan_many(files: DataFrame, rules: Sequence[C.LineRule]) -> DataFrame:
    """Findings of thousands of rules: an automaton proposes, the regex engine decides.

    One automaton over the text that each rule's match must hold, built once per Python worker,
    passes over a line once, however many rules there are; only rules it proposes try
    their pattern, which then is a column.  The plan does not grow with the rules.  Rules
    without such a text, of several lines or of once-per-line kind are unrolled as in ``scan``.
    """
    literals = [required_literal(rule.pattern) for rule in rules]
    fit = [rule.kind == "security" and rule.window == 1 and len(literal) >= LEAST_LITERAL
           for rule, literal in zip(rules, literals)]
    rest = _scan_unrolled(files, tuple(rule for rule, ok in zip(rules, fit) if not ok))
    chosen = [(rule, literal) for rule, literal, ok in zip(rules, literals, fit) if ok]
    if not chosen:
        return rest
    table = files.sparkSession.createDataFrame(
        [(i, r.rule_id, _regex(r), r.gate, list(r.languages), r.kind, r.name, r.severity, r.confidence,
          r.message, r.remediation, r.cwe_id) for i, (r, _) in enumerate(chosen)],
        "__no int, rule_id string, __regex string, __gate string, __languages array<string>, "
        "finding_type string, rule_name string, severity string, confidence string, message string, "
        "suggestion string, cwe_id string")
    folded = F.lower(F.translate("line", *FOLDED))
    line, regex = F.col("line"), F.col("__regex")
    everywhere = F.array_contains("__languages", "*")
    hits = (
        explode_lines(files.filter(F.col("language").isNotNull()))
        .withColumn("__no", F.explode(_literals_in(tuple(text for _, text in chosen))(folded)))
        .join(table, "__no")
        .where(everywhere | F.array_contains("__languages", F.col("language")))
        .where(line.contains(F.col("__gate")) & F.rlike(line, regex))
        .withColumn("__span", F.explode(_fold_spans(
            F.regexp_extract_all(line, regex, 0), F.split(line, regex, -1))))
    )
    found = hits.select(
        "finding_type", "rule_id", "rule_name", "severity", "confidence", "message",
        *[c for c in KEYS if c in files.columns],
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
        F.col("__span.begin").alias("column_start"),
        F.col("__span.end").alias("column_end"),
        X.strip(line).alias("code_snippet"),
        "suggestion", "cwe_id",
        owasp_of(F.col("cwe_id")).alias("owasp_category"),
    )
    return found.unionByName(rest)


def security_scan(
    files: DataFrame, rules: Sequence[C.LineRule] = C.SECURITY_RULES
) -> DataFrame:
    """Every match of every applicable rule on every line, as findings rows."""
    return scan(files, rules)


def performance_scan(
    files: DataFrame, rules: Sequence[C.LineRule] = C.PERFORMANCE_RULES
) -> DataFrame:
    """At most one finding per rule and line, windows starting on that line."""
    return scan(files, rules).drop(
        "confidence", "column_start", "column_end", "cwe_id", "owasp_category"
    )


def owasp_of(cwe: Column) -> Column:
    """OWASP category of a CWE, NULL where unmapped."""
    by_category: dict[str, list[str]] = {}
    for key, value in C.CWE_TO_OWASP.items():
        by_category.setdefault(value, []).append(key)
    expr = None
    for value, keys in by_category.items():
        expr = F.when(cwe.isin(*keys), F.lit(value)) if expr is None else expr.when(
            cwe.isin(*keys), F.lit(value)
        )
    return expr


def owasp_title(category: Column) -> Column:
    expr = None
    for k, v in C.OWASP_TITLES.items():
        expr = F.when(category == k, F.lit(v)) if expr is None else expr.when(
            category == k, F.lit(v)
        )
    return expr


# --- user rule tables ---------------------------------------------------------

RULE_SCHEMA = (
    "rule_id string, name string, pattern string, severity string, confidence string, "
    "message string, remediation string, cwe_id string, languages array<string>, enabled boolean"
)


def validate_rules(rules: DataFrame) -> tuple[list[C.LineRule], DataFrame]:
    """Split a user rule table into usable rules and a table of rejected ones.

    Patterns are tried by the regex engine that will run them.
    """
    spark: SparkSession = rules.sparkSession
    rows = rules.collect()
    good: list[C.LineRule] = []
    bad: list[tuple[str, str]] = []
    for row in rows:
        try:
            compile_java(spark, row["pattern"])
        except ValueError as error:
            bad.append((row["rule_id"], str(error)))
            continue
        if row["enabled"] is None or row["enabled"]:
            good.append(
                C.LineRule(
                    row["rule_id"], row["name"], row["severity"], row["message"],
                    row["remediation"], tuple(row["languages"] or ()), row["pattern"], "",
                    row["confidence"], row["cwe_id"],
                )
            )
    return good, spark.createDataFrame(bad, "rule_id string, error string")


def compile_java(spark: SparkSession, pattern: str) -> None:
    """Raise ValueError when the executors' regex engine rejects a pattern."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?iudU)" + pattern)
    except IllegalArgumentException as error:
        reason = str(error).splitlines()[0]
        raise ValueError(f"invalid pattern: {reason}") from None


def rules_dataframe(spark: SparkSession, rules: Sequence[C.LineRule]) -> DataFrame:
    """A catalog as a table."""
    return spark.createDataFrame(
        [
            (r.rule_id, r.name, r.pattern, r.severity, r.confidence, r.message,
             r.remediation, r.cwe_id, list(r.languages), True)
            for r in rules
        ],
        RULE_SCHEMA,
    )
