"""Source-to-sink flows inside a file.

Sources, sinks, and the lines that mention a tainted variable are arrays in
the file's row, so no join and no shuffle is needed.  Flows leave the row
through two explodes, source by source and then sink by sink: the sinks of a
source are references to the file's, and the pairs of a file are never all
rows at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..functions.bind import built_once, let, struct_of
from .rules import KEYS


def _contains(line: Column, word: str, whole: bool) -> Column:
    if not whole:
        return line.contains(word)
    quoted = re.escape(word)
    return F.rlike(line, F.lit(rf"(?U)(?<!\w){quoted}(?!\w)"))


def _variable(line: Column, pattern: str) -> Column:
    """Variable assigned from the pattern, else from its last dotted part."""
    def assigned(word: str) -> Column:
        return F.nullif(
            F.regexp_extract(line, rf"(?dU)(\w+)\s*=\s*\Q{word}\E", 1), F.lit("")
        )

    tail = pattern.split(".")[-1]
    full = assigned(pattern)
    return full if tail == pattern else F.coalesce(full, assigned(tail))


def _located(lines: Column, language: Column, catalog: dict, describe, whole: bool) -> Column:
    """Array of hits over all lines: one per pattern contained in a line."""
    def of_language(patterns: tuple) -> Column:
        def hits(line: Column, i: Column) -> Column:
            found = F.array(
                *[
                    F.when(
                        _contains(line, p[0], whole),
                        describe(p, line, i + 1, F.instr(line, F.lit(p[0]))),
                    )
                    for p in patterns
                ]
            )
            # The common case, no hit at all, allocates nothing.
            some = None
            for p in patterns:
                test = _contains(line, p[0], whole)
                some = test if some is None else some | test
            return F.when(some, F.array_compact(found))

        return F.flatten(F.array_compact(F.transform(lines, hits)))

    expr = None
    for name, patterns in catalog.items():
        cond = language == name
        expr = F.when(cond, of_language(patterns)) if expr is None else expr.when(
            cond, of_language(patterns)
        )
    return expr


def _source(p: tuple, line: Column, number: Column, column: Column) -> Column:
    return struct_of(
        name=F.lit(p[0]), line=number, col=column, level=F.lit(p[1]), type=F.lit(p[2]),
        variable=_variable(line, p[0]),
    )


def _sink(p: tuple, line: Column, number: Column, column: Column) -> Column:
    return struct_of(
        name=F.lit(p[0]), line=number, col=column, type=F.lit(p[1]), required=F.lit(p[2])
    )


def _keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


def _tracked(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language").isin(*C.TAINT_SOURCES))


@built_once
def _sources(whole: bool) -> Column:
    return let(
        X.split_lines(F.col("content")),
        lambda lines: _located(lines, F.col("language"), C.TAINT_SOURCES, _source, whole),
    )


@built_once
def _sinks(whole: bool) -> Column:
    return let(
        X.split_lines(F.col("content")),
        lambda lines: _located(lines, F.col("language"), C.TAINT_SINKS, _sink, whole),
    )


def taint_sources(files: DataFrame, word_boundary: bool = False) -> DataFrame:
    """One row per source pattern contained in a line, with its variable."""
    keys = _keys(files)
    return _tracked(files).select(*keys, F.explode(_sources(word_boundary)).alias("s")).select(
        *keys, F.col("s.name").alias("source_name"), F.col("s.line").alias("source_line"),
        F.col("s.col").alias("source_col"), F.col("s.level").alias("level"),
        F.col("s.type").alias("source_type"), F.col("s.variable").alias("variable"),
    )


def taint_sinks(files: DataFrame, word_boundary: bool = False) -> DataFrame:
    """One row per sink pattern contained in a line."""
    keys = _keys(files)
    return _tracked(files).select(*keys, F.explode(_sinks(word_boundary)).alias("s")).select(
        *keys, F.col("s.name").alias("sink_name"), F.col("s.line").alias("sink_line"),
        F.col("s.col").alias("sink_col"), F.col("s.type").alias("sink_type"),
        F.col("s.required").alias("required_level"),
    )


def _sanitizers_on(line: Column, language: Column, whole: bool) -> Column:
    expr = None
    for name, words in C.SANITIZERS.items():
        found = F.array_compact(
            F.array(*[F.when(_contains(line, w, whole), F.lit(w)) for w in words])
        )
        expr = F.when(language == name, found) if expr is None else expr.when(
            language == name, found
        )
    return expr


@built_once
def _followed(whole: bool, paths: bool, reached: bool = False) -> Column:
    """Array of sources with a variable, each with the sinks it flows to.

    Each source has all its later sinks.  With ``paths`` it also has the lines that mention the
    variable; without, only the first of them with a sanitizer (``safe_after``), so there is no
    list per flow.  With ``reached`` just the sinks before a sanitizer are kept.
    """
    language = F.col("language")

    def mentions(lines: Column, variable: Column) -> Column:
        """All lines that mention a variable, with their sanitizers."""
        return F.array_compact(
            F.transform(
                lines,
                lambda line, i: F.when(
                    line.contains(variable),
                    struct_of(
                        line=i + 1,
                        col=F.instr(line, variable),
                        cleaned=_sanitizers_on(line, language, whole),
                    ),
                ),
            )
        )

    def per_source(lines: Column, sources: Column, sinks: Column) -> Column:
        # Lines are searched once per variable, not once per source.
        by_variable = F.transform(
            F.array_distinct(F.transform(sources, lambda s: s["variable"])),
            lambda v: struct_of(
                variable=v,
                found=mentions(lines, v) if paths
                else F.filter(mentions(lines, v), lambda m: F.size(m["cleaned"]) > 0),
            ),
        )

        def follow(all_mentions: Column, s: Column) -> Column:
            mine = F.filter(all_mentions, lambda m: m["variable"] == s["variable"])[0]["found"]
            if not paths:
                cleaned = F.filter(mine, lambda m: m["line"] >= s["line"])
                safe_after = F.coalesce(F.get(cleaned, F.lit(0))["line"], F.lit(2**31 - 1))
                return let(
                    safe_after,
                    lambda last: struct_of(
                        source=s,
                        sinks=F.filter(sinks, lambda k: (k["line"] > s["line"]) & (
                            (k["line"] <= last) if reached else F.lit(True))),
                        safe_after=last,
                    ),
                )
            return struct_of(
                source=s,
                sinks=F.filter(sinks, lambda k: k["line"] > s["line"]),
                mentions=F.filter(mine, lambda m: m["line"] >= s["line"]),
            )

        return let(by_variable, lambda found: F.transform(sources, lambda s: follow(found, s)))

    def followed(lines: Column) -> Column:
        sources = F.filter(
            _located(lines, language, C.TAINT_SOURCES, _source, whole),
            lambda s: s["variable"].isNotNull(),
        )
        sinks = _located(lines, language, C.TAINT_SINKS, _sink, whole)
        return let(
            sources,
            lambda found: F.when(
                F.size(found) > 0,
                let(sinks, lambda all_sinks: per_source(lines, found, all_sinks)),
            ),
        )

    return let(X.split_lines(F.col("content")), followed)


def _level_reaches() -> Column:
    """Whether a source is at least as tainted as the sink requires."""
    levels = F.array(*[F.lit(v) for v in ("low", "medium", "high", "critical")])
    return F.array_position(levels, F.col("source.level")) >= F.array_position(
        levels, F.col("sink.required")
    )


def _flow_columns() -> list[Column]:
    return [
        F.col("source.name").alias("source_name"),
        F.col("source.line").alias("source_line"),
        F.col("source.col").alias("source_col"),
        F.col("source.level").alias("level"),
        F.col("source.type").alias("source_type"),
        F.col("source.variable").alias("variable"),
        F.col("sink.name").alias("sink_name"),
        F.col("sink.line").alias("sink_line"),
        F.col("sink.col").alias("sink_col"),
        F.col("sink.type").alias("sink_type"),
    ]


def taint_flows(
    files: DataFrame, word_boundary: bool = False, check_level: bool = False, paths: bool = True
) -> DataFrame:
    """One row per source and later sink of a file, with its path if ``paths``.

    The path lists the lines from the source up to the sink that mention the
    variable; a sanitizer on any of them makes the flow safe.  With
    ``check_level`` a flow also needs a source at least as tainted as the sink
    requires.  Without paths a flow holds no list: the first sanitized line of its source
    decides, and flow_steps has the lines of the paths once for each variable.
    """
    keys = _keys(files)
    if not paths:
        flows = _unlisted_flows(files, word_boundary, False)
        tainted = F.col("sink.line") <= F.col("safe_after")
        if check_level:
            tainted = tainted & _level_reaches()
        return flows.select(*keys, *_flow_columns(), tainted.alias("is_vulnerable"))
    # Files without any assignment never build the arrays.
    per_sink = (
        _tracked(files)
        .filter(F.col("content").contains("="))
        .select(*keys, F.explode(_followed(word_boundary, True)).alias("f"))
        .select(*keys, "f.source", "f.mentions", F.explode("f.sinks").alias("sink"))
    )
    before = F.filter("mentions", lambda m: m["line"] < F.col("sink.line"))
    path = F.concat(
        F.array(struct_of(line=F.col("source.line"), col=F.col("source.col"))),
        F.transform("__before", lambda m: struct_of(line=m["line"], col=m["col"])),
        F.array(struct_of(line=F.col("sink.line"), col=F.col("sink.col"))),
    )
    tainted = F.size("__cleaned") == 0
    if check_level:
        tainted = tainted & _level_reaches()
    return (
        per_sink.withColumn("__before", before)
        .withColumn("__cleaned", F.flatten(F.transform("__before", lambda m: m["cleaned"])))
        .select(
            *keys, *_flow_columns(), path.alias("flow_path"),
            F.col("__cleaned").alias("sanitizers"), tainted.alias("is_vulnerable"),
        )
    )


def _unlisted_flows(files: DataFrame, word_boundary: bool, reached: bool) -> DataFrame:
    """(keys, source, safe_after, sink): flows without a list, all or those not made safe."""
    keys = _keys(files)
    return (
        _tracked(files)
        .filter(F.col("content").contains("="))
        .select(*keys, F.explode(_followed(word_boundary, False, reached)).alias("f"))
        .select(*keys, "f.source", "f.safe_after", F.explode("f.sinks").alias("sink"))
    )


def vulnerable_flows(
    files: DataFrame, word_boundary: bool = False, check_level: bool = False
) -> DataFrame:
    """The vulnerable rows of taint_flows without their paths, at a fraction of the work."""
    flows = _unlisted_flows(files, word_boundary, True)
    if check_level:
        flows = flows.filter(_level_reaches())
    return flows.select(*_keys(files), *_flow_columns(), F.lit(True).alias("is_vulnerable"))


def flow_steps(files: DataFrame, word_boundary: bool = False) -> DataFrame:
    """One row per tainted variable and line that mentions it, with the sanitizers there.

    The path of a flow is its source, the steps of its variable from the source's line to
    before the sink's, and its sink: path_of joins them by position where paths are asked for.
    """
    keys = _keys(files)
    lines, variable = X.split_lines(F.col("content")), F.col("variable")
    return (
        _tracked(files)
        .filter(F.col("content").contains("="))
        .select(*keys, "language", lines.alias("__lines"),
                F.array_distinct(F.transform(_sources(word_boundary), lambda s: s["variable"]))
                .alias("__variables"))
        .select(*keys, "language", "__lines", F.explode("__variables").alias("variable"))
        .filter(variable.isNotNull())
        .select(*keys, "language", "variable",
                F.posexplode("__lines").alias("__at", "__line"))
        .filter(F.col("__line").contains(variable))
        .select(*keys, "variable", (F.col("__at") + 1).alias("line"),
                F.instr(F.col("__line"), variable).alias("col"),
                _sanitizers_on(F.col("__line"), F.col("language"), word_boundary)
                .alias("sanitizers"))
    )


def path_of(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(flow columns, line, col, sanitizers): the steps between the ends of some flows.

    A join by file and variable with a range of lines; ``flows`` are the few whose paths are
    wanted, and a flow without steps in between has no row.
    """
    keys = [c for c in KEYS if c in flows.columns]
    step = steps.select(*keys, "variable", *[
        F.col(c).alias(f"step_{c}") for c in ("line", "col", "sanitizers")])
    return flows.join(step, [*keys, "variable"]).filter(
        (F.col("step_line") >= F.col("source_line")) & (F.col("step_line") < F.col("sink_line"))
    )


def _of_sink(index: int) -> Column:
    """CASE over the sink type: vulnerability, CWE or remediation."""
    expr = None
    for kind, values in C.SINK_FINDINGS.items():
        cond = F.col("sink_type") == kind
        value = F.lit(values[index])
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(C.DEFAULT_SINK_FINDING[index]))


def taint_findings(flows: DataFrame) -> DataFrame:
    """Vulnerable flows as findings rows."""
    keys = [c for c in flows.columns if c in KEYS]
    return flows.filter("is_vulnerable").select(
        F.lit("taint").alias("finding_type"),
        F.concat(F.lit("TAINT-"), F.upper("sink_type")).alias("rule_id"),
        _of_sink(0).alias("rule_name"),
        _of_sink(0).alias("vulnerability_type"),
        F.when(F.col("level").isin("critical", "high", "medium", "low"), F.col("level"))
        .otherwise("medium").alias("severity"),
        F.format_string(
            "Potential %s vulnerability: Untrusted data from '%s' (line %d) "
            "flows to '%s' (line %d)",
            _of_sink(0), "source_name", "source_line", "sink_name", "sink_line",
        ).alias("message"),
        *keys,
        F.col("source_line").alias("line_start"),
        F.col("sink_line").alias("line_end"),
        _of_sink(2).alias("suggestion"),
        _of_sink(1).alias("cwe_id"),
    )
