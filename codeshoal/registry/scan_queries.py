"""Registered queries: rule scans, structure, metrics and taint."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..operators import metrics as M
from ..operators import resolve as RS
from ..operators import rules as R
from ..operators import structure as S
from ..operators import taint as T
from ..sources import files as SRC
from .base import code_files, sql_text, table, with_files

WS = sql_text(C.WHITESPACE)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _gate(languages) -> str:
    return "language IS NOT NULL" if "*" in languages else f"language IN {_in(languages)}"


# --- line rules -----------------------------------------------------------------


def _security_part(rule) -> str:
    pattern = sql_text("(?i)" + rule.pattern)
    owasp = C.CWE_TO_OWASP.get(rule.cwe_id)
    return f"""SELECT file_id, path, language, line_no AS line_start, line, '{rule.rule_id}' AS rule_id,
    {sql_text(rule.name)} AS rule_name, '{rule.severity}' AS severity,
    '{rule.confidence}' AS confidence, '{rule.cwe_id}' AS cwe_id,
    {f"'{owasp}'" if owasp else "NULL"} AS owasp_category,
    regexp_extract_all(line, {pattern}, 0) AS hits,
    string_split_regex(line, {pattern}) AS gaps
  FROM lines WHERE {_gate(rule.languages)} AND regexp_matches(line, {pattern})"""


SECURITY = "security AS (SELECT * FROM (" + " UNION ALL ".join(
    _security_part(r) for r in C.SECURITY_RULES
) + "), (SELECT unnest(range(1, 1000)) AS k) WHERE k <= len(hits))"
BEGIN = """CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS INT)"""


def d1(spark, sf):
    return R.security_scan(code_files(spark, sf)).select(
        "file_id", "path", "language", "rule_id", "rule_name", "severity", "confidence",
        "line_start", "column_start", "column_end", "code_snippet", "cwe_id",
        F.coalesce("owasp_category", F.lit("-")).alias("owasp_category"),
    )


D1_SQL = with_files(f"""
SELECT file_id, path, language, rule_id, rule_name, severity, confidence, line_start,
  {BEGIN} AS column_start, {BEGIN} + length(hits[k]) AS column_end,
  trim(line, {WS}) AS code_snippet, cwe_id, coalesce(owasp_category, '-') AS owasp_category
FROM security""", SECURITY, lines=True)


def c1(spark, sf):
    """Rules applicable per language of the files at hand."""
    files = code_files(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    applicable = F.array_compact(
        F.array(
            *[F.when(R.applies(r, F.col("language")), F.lit(r.rule_id)) for r in C.SECURITY_RULES]
        )
    )
    return files.select("language", "files", F.explode(applicable).alias("rule_id"))


_RULE_ROWS = ", ".join(
    f"('{r.rule_id}', '{lang}')" for r in C.SECURITY_RULES for lang in r.languages
)
C1_SQL = with_files(f"""
SELECT language, count(*) AS files, rule_id FROM code_files
JOIN (VALUES {_RULE_ROWS}) r(rule_id, lang) ON lang = '*' OR lang = language
WHERE language IS NOT NULL GROUP BY ALL""")


def d11(spark, sf):
    found = R.security_scan(code_files(spark, sf))
    return found.groupBy("cwe_id", F.coalesce("owasp_category", F.lit("-")).alias("owasp")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("title", F.coalesce(R.owasp_title(F.col("owasp")), F.lit("-")))


_TITLES = ", ".join(f"('{k}', {sql_text(v)})" for k, v in C.OWASP_TITLES.items())
D11_SQL = with_files(f"""
SELECT cwe_id, coalesce(owasp_category, '-') AS owasp, coalesce(title, '-') AS title, count(*) AS n
FROM security LEFT JOIN (VALUES {_TITLES}) t(code, title) ON code = owasp_category
GROUP BY ALL""", SECURITY, lines=True)


def _performance_part(rule) -> str:
    text = "line" if rule.window == 1 else "line || chr(10) || next1"
    if rule.rule_id == "PERF-P005":
        # No back-references here: try every `c.d` of the first line.
        test = """list_bool_or(list_transform(range(1, length(line) - 1), lambda i:
          regexp_matches(substr(line, i, 3), '^\\w[.]\\w$') AND contains(next1, substr(line, i, 3))
          AND contains(next2, substr(line, i, 3))))"""
        text = ""
    else:
        test = f"regexp_matches({text}, {sql_text(rule.pattern)})"
    return f"""SELECT file_id, path, language, line_no AS line_start, line, '{rule.rule_id}' AS rule_id,
    {sql_text(rule.name)} AS rule_name, '{rule.severity}' AS severity,
    {sql_text(rule.message)} AS message FROM lines WHERE {_gate(rule.languages)} AND {test}"""


PERFORMANCE = "performance AS (" + " UNION ALL ".join(
    _performance_part(r) for r in C.PERFORMANCE_RULES
) + ")"


def _performance(windows):
    rules = [r for r in C.PERFORMANCE_RULES if (r.window > 1) in windows]

    def run(spark, sf):
        return R.performance_scan(code_files(spark, sf), rules).select(
            "file_id", "path", "rule_id", "rule_name", "severity", "message", "line_start",
            "code_snippet",
        )
    return run


def _performance_sql(rule_ids) -> str:
    return with_files(f"""
SELECT file_id, path, rule_id, rule_name, severity, message, line_start,
  trim(line, {WS}) AS code_snippet FROM performance WHERE rule_id IN {_in(rule_ids)}""",
        PERFORMANCE, lines=True)


# --- structure ------------------------------------------------------------------


def _blank_sql(text: str, quote: str) -> str:
    q = quote.replace("'", "''")
    return f"""CASE WHEN len(string_split({text}, '{q}')) % 2 = 1 THEN array_to_string(
      list_transform(string_split({text}, '{q}'), lambda p, i: CASE WHEN i % 2 = 0
        THEN concat('""', regexp_replace(p, '[^\\n]+', '', 'g'), chr(1)) ELSE p END), '')
      ELSE {text} END"""


_STRINGS = """regexp_replace(regexp_replace({0}, '\\\\.', '', 'g'),
    '"[^"\\n]*"|''[^''\\n]*''', '""', 'g')"""
_BLOCKS = """array_to_string(list_transform(string_split({0}, '/*'), lambda p, i:
    CASE WHEN i = 1 THEN p ELSE concat(regexp_replace(string_split(p, '*/')[1], '[^\\n]+', '', 'g'),
      substr(p, length(string_split(p, '*/')[1]) + 3)) END), '')"""
MASKED = f"""triple1 AS (SELECT file_id, repo_id, path, language, content,
    CASE WHEN language = 'python' THEN {_blank_sql('content', '"' * 3)}
      ELSE {_blank_sql('content', '`')} END AS m
  FROM code_files WHERE language IN ('python', 'javascript', 'java', 'go')),
triple2 AS (SELECT *, CASE WHEN language = 'python' THEN {_blank_sql('m', "'" * 3)} ELSE m END AS m2
  FROM triple1),
strings AS (SELECT *, {_STRINGS.format('m2')} AS m3 FROM triple2),
masked AS (SELECT file_id, repo_id, path, language, string_split(content, chr(10)) AS raw,
    string_split(CASE WHEN language = 'python' THEN regexp_replace(m3, '#[^\\n]*', '', 'g')
      ELSE regexp_replace({_BLOCKS.format('m3')}, '//[^\\n]*', '', 'g') END, chr(10)) AS a
  FROM strings),
mlines AS (SELECT file_id, repo_id, path, language, line_no, raw[line_no] AS raw, a[line_no] AS line,
    ltrim(a[line_no]) AS body
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS line_no FROM masked)),
code AS (SELECT *, length(line) - length(body) AS indent,
    length(line) - length(replace(line, '{{', '')) AS opens,
    length(line) - length(replace(line, '}}', '')) AS closes,
    CASE WHEN language = 'python' THEN
        CAST(regexp_matches(line, {sql_text(S.PY_DECISION)}) AS INT)
        + len(regexp_extract_all(regexp_replace(line, {sql_text(S.PY_KEYWORD)}, ''),
            {sql_text(S.PY_TERNARY)}))
      WHEN language = 'javascript' THEN len(regexp_extract_all(line, {sql_text(S.JS_DECISION)}))
        + len(regexp_extract_all(line, {sql_text(S.JS_FOR)}))
        - len(regexp_extract_all(line, {sql_text(S.JS_DO_TAIL)})) ELSE 0 END AS hits
  FROM mlines WHERE trim(body) <> ''),
depths AS (SELECT *, coalesce(sum(opens - closes) OVER (PARTITION BY file_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(opens - closes) OVER (PARTITION BY file_id ORDER BY line_no) AS after FROM code)"""
_JAVA = sql_text(S.JAVA_METHOD)
DEFINED = f"""defs AS (
  SELECT *, 'function' AS kind, regexp_extract(line, '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1) AS name
    FROM depths WHERE language = 'python'
  UNION ALL SELECT *, 'class', regexp_extract(line, '^\\s*class\\s+(\\w+)\\s*[:(]', 1)
    FROM depths WHERE language = 'python'
  UNION ALL SELECT *, 'function', regexp_extract(line, {sql_text(S.JS_DECL)}, 1)
    FROM depths WHERE language = 'javascript'
  UNION ALL SELECT *, 'function', CASE WHEN regexp_matches(
      regexp_extract(line, {sql_text(S.JS_METHOD)}, 1), {sql_text(S.NOT_METHODS)}) THEN ''
      ELSE regexp_extract(line, {sql_text(S.JS_METHOD)}, 1) END
    FROM depths WHERE language = 'javascript'
  UNION ALL SELECT *, 'class', regexp_extract(line, {sql_text(S.JS_CLASS)}, 1)
    FROM depths WHERE language = 'javascript'
  UNION ALL SELECT *, 'function', '<anonymous>' FROM depths
    WHERE language = 'javascript' AND contains(line, '=>')
  UNION ALL SELECT *, 'function', CASE WHEN regexp_matches(regexp_extract(line, {_JAVA}, 1),
      {sql_text(S.NOT_TYPES)}) OR regexp_matches(regexp_extract(line, {_JAVA}, 2),
      {sql_text(S.NOT_METHODS)}) THEN '' ELSE regexp_extract(line, {_JAVA}, 2) END
    FROM depths WHERE language = 'java'
  UNION ALL SELECT *, 'class', regexp_extract(line, {sql_text(S.JAVA_CLASS)}, 1)
    FROM depths WHERE language = 'java'
  UNION ALL SELECT *, 'function', regexp_extract(line, {sql_text(S.GO_FUNC)}, 1)
    FROM depths WHERE language = 'go'),
ends AS (SELECT d.file_id, d.line_no, d.kind, d.name,
    min(CASE WHEN d.language = 'python' AND c.line_no > d.line_no AND c.indent <= d.indent
        AND left(c.body, 1) NOT IN (')', ']', '}}', chr(1)) THEN c.line_no
      WHEN d.language <> 'python' AND c.line_no >= d.line_no AND c.after <= d.before
      THEN c.line_no END) AS stopper, max(c.line_no) AS last
  FROM defs d JOIN depths c ON c.file_id = d.file_id WHERE d.name <> '' GROUP BY ALL),
entries AS (SELECT d.*, CASE WHEN d.language = 'python' THEN
      (SELECT max(c.line_no) FROM depths c WHERE c.file_id = d.file_id
        AND c.line_no < coalesce(e.stopper, e.last + 1))
    ELSE coalesce(e.stopper, e.last) END AS stop
  FROM defs d JOIN ends e ON e.file_id = d.file_id AND e.line_no = d.line_no AND e.kind = d.kind
    AND e.name = d.name),
measured AS (SELECT * EXCLUDE (hits), CAST(CASE WHEN language IN ('python', 'javascript')
    THEN 1 + hits ELSE 1 END AS INT) AS complexity
  FROM (SELECT e.file_id, e.repo_id, e.path, e.language, e.kind, e.name, e.raw,
      CAST(e.line_no AS INT) AS start_line, CAST(e.stop AS INT) AS end_line, e.indent,
      sum(c.hits) AS hits
    FROM entries e JOIN code c ON c.file_id = e.file_id AND c.line_no BETWEEN e.line_no AND e.stop
    GROUP BY ALL))""".replace("}}", "}")
FUNCTIONS = [MASKED, DEFINED]


def p1(spark, sf):
    return S.functions(code_files(spark, sf)).select(
        "file_id", "path", "name", "start_line", "end_line", "complexity",
        F.array_join("parameters", "|").alias("parameters"),
        F.coalesce("return_type", F.lit("")).alias("return_type"),
    )


P1_SQL = with_files(f"""
SELECT file_id, path, name, start_line, end_line, complexity,
  CASE language WHEN 'go' THEN '' ELSE array_to_string(list_filter(list_transform(
    string_split(regexp_extract(raw, '^[^(]*\\((.*?)\\)', 1), ','), lambda p: trim(p)),
    lambda p: CASE WHEN language = 'python' THEN regexp_matches(p, '^\\w+$|^\\w+\\s*=|^\\w+\\s*:[^=]*$')
      ELSE p <> '' END), '|') END AS parameters,
  CASE language WHEN 'python' THEN regexp_extract(raw, '->\\s*(.+?)\\s*:', 1)
    WHEN 'java' THEN regexp_extract(raw, '^\\s*(?:public\\s+)?(\\w+)\\s', 1) ELSE '' END AS return_type
FROM measured WHERE kind = 'function'""", *FUNCTIONS)


def p2(spark, sf):
    return S.classes(code_files(spark, sf)).select(
        "file_id", "name", "start_line", "end_line",
        F.array_join("parent_classes", "|").alias("parents"),
        F.array_join(F.transform("methods", lambda m: m["name"]), "|").alias("methods"),
    )


P2_SQL = with_files("""
SELECT c.file_id, c.name, c.start_line, c.end_line,
  CASE c.language WHEN 'python' THEN array_to_string(list_transform(string_split(
      regexp_extract(c.raw, '\\((.*)\\)', 1), ','), lambda p: trim(p)), '|')
    WHEN 'javascript' THEN regexp_extract(c.raw, 'extends\\s+(\\w+)', 1) ELSE '' END AS parents,
  coalesce(string_agg(f.name, '|' ORDER BY f.start_line) FILTER (c.language <> 'java'), '') AS methods
FROM measured c LEFT JOIN measured f ON f.file_id = c.file_id AND f.kind = 'function'
  AND f.start_line > c.start_line AND f.end_line <= c.end_line AND f.name <> '<anonymous>'
  AND NOT EXISTS (SELECT 1 FROM measured o WHERE o.file_id = f.file_id AND o.kind = 'function'
    AND o.start_line < f.start_line AND o.end_line >= f.end_line AND o.start_line > c.start_line)
WHERE c.kind = 'class' GROUP BY ALL""", *FUNCTIONS)


def p3(spark, sf):
    return S.imports(code_files(spark, sf)).select(
        "file_id", "line_no", "module", F.array_join("names", "|").alias("names"),
        F.col("is_from_import").cast("int").alias("is_from"),
    )


P3_SQL = with_files("""
SELECT file_id, CAST(line_no AS INT) AS line_no,
  CASE WHEN language = 'javascript' THEN regexp_extract(raw, 'from\\s+"([^"]+)"', 1)
    WHEN starts_with(raw, 'from') THEN regexp_extract(raw, '^from\\s+(\\S+)', 1)
    ELSE regexp_extract(raw, '^\\s*import\\s+(\\w+)', 1) END AS module,
  CASE WHEN language = 'javascript' THEN regexp_extract(raw, '^import\\s+(\\w+)', 1)
    WHEN starts_with(raw, 'from') THEN regexp_extract(raw, 'import\\s+(\\w+)', 1) ELSE '' END AS names,
  CASE WHEN language = 'javascript' OR starts_with(raw, 'from') THEN 1 ELSE 0 END AS is_from
FROM mlines WHERE (language = 'python' AND regexp_matches(line, '^\\s*(from\\s+\\S+\\s+)?import\\s'))
  OR (language = 'javascript' AND regexp_matches(line, '^import\\s'))""", MASKED)


def p4(spark, sf):
    return (
        S.functions(code_files(spark, sf))
        .groupBy("language", "complexity").agg(F.count(F.lit(1)).alias("n"))
    )


P4_SQL = with_files("""SELECT language, complexity, count(*) AS n FROM measured
WHERE kind = 'function' GROUP BY ALL""", *FUNCTIONS)


def p5(spark, sf):
    return S.call_edges(code_files(spark, sf))


# Packages of up to 50 modules that all define the same name; callers take one by its package, through
# a re-export every third time, or leave it open.
def _packages(spark, sf):
    doc = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "source").where("doc_id IS NOT NULL")
    package = F.concat(F.lit("pkg"), F.floor(doc / 50).cast("string"))
    module = F.concat(F.lit("m"), doc.cast("string"))
    caller = F.concat(
        F.when(doc % 3 == 0, F.concat(F.lit("from "), package, F.lit(" import make"), doc, F.lit(" as got\n")))
        .when(doc % 3 == 1, F.concat(F.lit("import "), package, F.lit("."), module, F.lit(" as lib\n")))
        .otherwise(F.lit("")),
        F.lit("def call"), doc, F.lit("():\n    "),
        F.when(doc % 3 == 0, F.lit("got()")).when(doc % 3 == 1, F.lit("lib.make()"))
        .otherwise(F.lit("x.make()")), F.lit("\n"))
    files = [
        (F.concat(package, F.lit("/"), module, F.lit(".py")),
         F.lit("def make():\n    return 1\n")),
        (F.concat(F.lit("use/c"), doc, F.lit(".py")), caller)]
    written = docs.select(F.explode(F.array(*(
        F.struct(p.alias("path"), t.alias("content")) for p, t in files))).alias("f")).select("f.*")
    # One more file for each package: it re-exports its modules' functions.
    exports = docs.groupBy(package.alias("p")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(
        F.lit("from ."), module, F.lit(" import make as make"), doc))), "\n").alias("content")).select(
        F.concat("p", F.lit("/__init__.py")).alias("path"), "content")
    return written.unionByName(exports).select(
        F.lit(0).cast("long").alias("file_id"), F.lit("r").alias("repo_id"), "path",
        F.lit("python").alias("language"), "content")


def p5_resolved(spark, sf):
    return RS.resolved_calls(_packages(spark, sf)).select(
        "path", "name", "call", "target_path", "target_name", "how")


P5_RESOLVED_SQL = """SELECT concat('use/c', doc_id, '.py') AS path, concat('call', doc_id) AS name,
  CASE doc_id % 3 WHEN 0 THEN 'got' WHEN 1 THEN 'lib.make' ELSE 'x.make' END AS call,
  CASE doc_id % 3 WHEN 2 THEN (SELECT min(concat('pkg', doc_id // 50, '/m', doc_id, '.py')) FROM documents)
    ELSE concat('pkg', doc_id // 50, '/m', doc_id, '.py') END AS target_path,
  'make' AS target_name, CASE doc_id % 3 WHEN 2 THEN 'guess' ELSE 'import' END AS how
FROM documents WHERE doc_id IS NOT NULL"""

CALLS = r"""names AS (SELECT DISTINCT repo_id, path, name FROM measured WHERE kind = 'function'),
called AS (SELECT DISTINCT m.repo_id, m.path, m.name, unnest(regexp_extract_all(
    CASE WHEN l.line_no = m.start_line THEN regexp_replace(l.line, '^[^(]*\(', '')
      ELSE regexp_replace(l.line, '\b(def|class|function|func)\s+\w+', '', 'g') END,
    '(\w+)\s*\(', 1)) AS callee
  FROM measured m JOIN mlines l ON l.file_id = m.file_id
    AND l.line_no BETWEEN m.start_line AND m.end_line WHERE m.kind = 'function'),
calls AS (SELECT DISTINCT md5(concat(c.repo_id, ':', c.path, ':', c.name)) AS src,
    md5(concat(c.repo_id, ':', coalesce(max(CASE WHEN n.path = c.path THEN n.path END), min(n.path)),
      ':', c.callee)) AS dst, 'direct' AS type
  FROM called c JOIN names n ON n.repo_id = c.repo_id AND n.name = c.callee
  WHERE c.callee NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'with')
  GROUP BY c.repo_id, c.path, c.name, c.callee)"""
P5_SQL = with_files("SELECT src, dst, type FROM calls", *FUNCTIONS, CALLS)


def d2(spark, sf):
    return S.dangerous_definitions(code_files(spark, sf)).select(
        "file_id", "path", "rule_id", "severity", "message", "line_start", "line_end", "cwe_id",
        "owasp_category",
    )


_DANGEROUS = ", ".join(f"('{k}', '{n}')" for k, v in C.DANGEROUS_FUNCTIONS.items() for n in v)
D2_SQL = with_files(f"""
SELECT file_id, path, 'CS-AST001' AS rule_id, 'high' AS severity,
  concat('Potentially dangerous function ''', m.name, ''' detected') AS message,
  start_line AS line_start, end_line AS line_end, 'CWE-94' AS cwe_id, 'A03' AS owasp_category
FROM measured m JOIN (VALUES {_DANGEROUS}) d(language, name) USING (language, name)
WHERE kind = 'function'""", *FUNCTIONS)


def d4(spark, sf):
    return S.imports_in_functions(code_files(spark, sf)).select(
        "file_id", "path", "rule_id", "message", "line_start", "code_snippet"
    )


D4_SQL = with_files(f"""
SELECT m.file_id, m.path, 'PERF-P006' AS rule_id,
  concat('Import statement inside function ''', m.name, '''') AS message,
  CAST(l.line_no AS INT) AS line_start, trim(l.raw, {WS}) AS code_snippet
FROM measured m JOIN mlines l ON l.file_id = m.file_id
  AND l.line_no BETWEEN m.start_line AND m.end_line
WHERE m.kind = 'function' AND m.language = 'python'
  AND (starts_with(trim(l.raw, {WS}), 'import ') OR starts_with(trim(l.raw, {WS}), 'from '))""",
    *FUNCTIONS)


def d5(spark, sf):
    """For every security finding, the function and class around it."""
    files = code_files(spark, sf)
    found = R.security_scan(files).select(
        "file_id", "rule_id", "column_start", F.col("line_start").alias("line_no")
    )
    inside = S.covering(S.covering(found, files, "function"), files, "class")
    return inside.select(
        "file_id", "rule_id", "column_start", "line_no",
        F.coalesce("function", F.lit("-")).alias("function"),
        F.coalesce("class", F.lit("-")).alias("class"),
    )


D5_SQL = with_files(f"""
SELECT s.file_id, s.rule_id, {BEGIN} AS column_start, CAST(s.line_start AS INT) AS line_no,
  coalesce((SELECT arg_min(m.name, m.start_line) FROM measured m WHERE m.file_id = s.file_id
    AND m.kind = 'function' AND s.line_start BETWEEN m.start_line AND m.end_line), '-') AS "function",
  coalesce((SELECT arg_min(m.name, m.start_line) FROM measured m WHERE m.file_id = s.file_id
    AND m.kind = 'class' AND s.line_start BETWEEN m.start_line AND m.end_line), '-') AS "class"
FROM security s""", "@LINES", SECURITY, *FUNCTIONS)


def _with_lines(sql: str) -> str:
    from .base import LINES
    return sql.replace("@LINES", LINES)


# --- metrics --------------------------------------------------------------------


def _metrics(spark, sf):
    return M.function_metrics(S.functions(code_files(spark, sf)))


def b28(spark, sf):
    return _metrics(spark, sf).select(
        "file_id", "name", "start_line", "cyclomatic", "cognitive", "loc", "volume", "difficulty",
        F.round("maintainability", 2).alias("maintainability"),
    )


METRICS = """metrics AS (SELECT *, end_line - start_line AS loc,
    CASE WHEN end_line > start_line THEN round(greatest(0, 171 - 5.2 * ln((end_line - start_line) * 10)
      - 0.23 * complexity - 16.2 * ln(end_line - start_line)), 2) ELSE 100.0 END AS maintainability
  FROM measured WHERE kind = 'function')"""
B28_SQL = with_files("""
SELECT file_id, name, start_line, complexity AS cyclomatic, complexity AS cognitive, loc,
  CAST(loc * 10 AS DOUBLE) AS volume, CAST(complexity * 0.5 AS DOUBLE) AS difficulty, maintainability
FROM metrics""", *FUNCTIONS, METRICS)


def b29(spark, sf):
    return S.functions(code_files(spark, sf)).select(
        "file_id", "name", "start_line", M.nesting(F.col("complexity")).alias("nesting")
    )


B29_SQL = with_files("""SELECT file_id, name, start_line,
  CAST(least(complexity // 3, 10) AS INT) AS nesting FROM metrics""", *FUNCTIONS, METRICS)


def c9(spark, sf):
    return M.threshold_findings(_metrics(spark, sf)).select(
        "file_id", "rule_id", "severity", "message", "line_start", "line_end"
    )


C9_SQL = with_files("""
SELECT file_id, 'PERF-C001' AS rule_id, 'high' AS severity, concat('Function ''', name,
    ''' has very high cyclomatic complexity (', complexity, ')') AS message,
    start_line AS line_start, end_line AS line_end FROM metrics WHERE complexity > 50
UNION ALL SELECT file_id, 'PERF-C002', 'medium', concat('Function ''', name,
    ''' has high cyclomatic complexity (', complexity, ')'), start_line, end_line
  FROM metrics WHERE complexity > 20 AND complexity <= 50
UNION ALL SELECT file_id, 'PERF-S001', 'medium', concat('Function ''', name, ''' is very long (',
    loc, ' lines)'), start_line, end_line FROM metrics WHERE loc > 100
UNION ALL SELECT file_id, 'PERF-N001', 'medium', concat('Function ''', name,
    ''' has deep nesting (level ', least(complexity // 3, 10), ')'), start_line, end_line
  FROM metrics WHERE least(complexity // 3, 10) > 4""", *FUNCTIONS, METRICS)


def f4(spark, sf):
    return M.hot_paths(_metrics(spark, sf)).select(
        "file_id", "name", "cyclomatic", "loc", "maintainability", "rank"
    )


F4_SQL = with_files("""
SELECT file_id, name, complexity AS cyclomatic, loc, maintainability, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY complexity DESC, name) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY start_line DESC, end_line DESC)
      AS newest FROM metrics) WHERE newest = 1) WHERE rank <= 5""", *FUNCTIONS, METRICS)


def c8(spark, sf):
    return SRC.file_errors(code_files(spark, sf))


C8_SQL = with_files("""
SELECT file_id, path, CASE WHEN language IS NULL THEN concat('Unknown file type: ', path)
  ELSE concat('Parser not available for ', language) END AS error
FROM code_files WHERE language IS NULL OR language IN ('ruby', 'typescript')""")


# --- taint ----------------------------------------------------------------------


def _values(catalog) -> str:
    return ", ".join(
        "('" + language + "', " + ", ".join(f"'{x}'" for x in row) + ")"
        for language, rows in catalog.items() for row in rows
    )


_TAIL = "string_split(p.name, '.')[-1]"


def _assigned(word: str) -> str:
    return (
        f"nullif(regexp_extract(l.line, concat('(\\w+)\\s*=\\s*', replace({word}, '.', '\\.')), 1), '')"
    )


TAINT = f"""sources AS (SELECT l.file_id, l.language, p.name, CAST(l.line_no AS INT) AS line,
    CAST(strpos(l.line, p.name) AS INT) AS col, p.level, p.type,
    coalesce({_assigned('p.name')}, {_assigned(_TAIL)}) AS variable
  FROM lines l JOIN (VALUES {_values(C.TAINT_SOURCES)}) p(language, name, level, type)
    ON p.language = l.language AND contains(l.line, p.name)),
sinks AS (SELECT l.file_id, p.name, CAST(l.line_no AS INT) AS line,
    CAST(strpos(l.line, p.name) AS INT) AS col, p.type, p.required
  FROM lines l JOIN (VALUES {_values(C.TAINT_SINKS)}) p(language, name, type, required)
    ON p.language = l.language AND contains(l.line, p.name))"""
_SANITIZERS = ", ".join(f"('{k}', '{w}')" for k, ws in C.SANITIZERS.items() for w in ws)
FLOWS = f"""pairs AS (SELECT s.file_id, s.language, s.name AS source_name, s.line AS source_line,
    s.col AS source_col, s.level, s.type AS source_type, s.variable, k.name AS sink_name,
    k.line AS sink_line, k.col AS sink_col, k.type AS sink_type
  FROM sources s JOIN sinks k ON k.file_id = s.file_id AND k.line > s.line
  WHERE s.variable IS NOT NULL),
mentions AS (SELECT p.*, l.line_no, strpos(l.line, p.variable) AS col, (SELECT count(*)
    FROM (VALUES {_SANITIZERS}) z(language, word)
    WHERE z.language = p.language AND contains(l.line, z.word)) AS cleaned
  FROM pairs p JOIN lines l ON l.file_id = p.file_id AND l.line_no >= p.source_line
    AND l.line_no < p.sink_line AND contains(l.line, p.variable)),
flows AS (SELECT * EXCLUDE (steps), concat(source_line, ':', source_col, ' ', steps, ' ',
    sink_line, ':', sink_col) AS flow_path
  FROM (SELECT file_id, source_name, source_line, source_col, level, source_type, variable,
      sink_name, sink_line, sink_col, sink_type, CAST(sum(cleaned) AS INT) AS n_sanitizers,
      string_agg(concat(line_no, ':', col), ' ' ORDER BY line_no) AS steps
    FROM mentions GROUP BY ALL))"""


def d6_sources(spark, sf):
    return T.taint_sources(code_files(spark, sf)).select(
        "file_id", "source_name", "source_line", "source_col", "level", "source_type"
    )


def d6_sinks(spark, sf):
    return T.taint_sinks(code_files(spark, sf)).select(
        "file_id", "sink_name", "sink_line", "sink_col", "sink_type", "required_level"
    )


def d8(spark, sf):
    return T.taint_sources(code_files(spark, sf)).select(
        "file_id", "source_name", "source_line",
        F.coalesce("variable", F.lit("-")).alias("variable"),
    )


def d7(spark, sf):
    return T.taint_flows(code_files(spark, sf), paths=False).select(
        "file_id", "source_name", "source_line", "variable", "sink_name", "sink_line", "sink_type"
    )


def d9(spark, sf):
    step = F.transform("flow_path", lambda s: F.concat_ws(":", s["line"], s["col"]))
    return T.taint_flows(code_files(spark, sf)).select(
        "file_id", "source_name", "source_line", "sink_name", "sink_line",
        F.array_join(step, " ").alias("flow_path"),
        F.size("sanitizers").alias("n_sanitizers"),
        F.col("is_vulnerable").cast("int").alias("vulnerable"),
    )


def d10(spark, sf):
    return T.taint_findings(T.vulnerable_flows(code_files(spark, sf))).select(
        "file_id", "path", "vulnerability_type", "severity", "message", "line_start", "line_end",
        "suggestion", "cwe_id",
    )


_SINK_ROWS = ", ".join(
    f"('{k}', '{a}', '{b}', '{c}')" for k, (a, b, c) in C.SINK_FINDINGS.items()
)
TAINT_FINDINGS = f"""taint_findings AS (SELECT f.file_id, c.path, c.repo_id, v.vulnerability_type,
    f.level AS severity, concat('Potential ', v.vulnerability_type,
      ' vulnerability: Untrusted data from ''', f.source_name, ''' (line ', f.source_line,
      ') flows to ''', f.sink_name, ''' (line ', f.sink_line, ')') AS message,
    f.source_line AS line_start, f.sink_line AS line_end, v.suggestion, v.cwe_id, f.sink_type
  FROM flows f JOIN code_files c USING (file_id)
    JOIN (VALUES {_SINK_ROWS}) v(sink_type, vulnerability_type, cwe_id, suggestion) USING (sink_type)
  WHERE f.n_sanitizers = 0)"""

QUERIES = {
    "d1_rule_scan": (d1, D1_SQL),
    "c1_rule_applicability": (c1, C1_SQL),
    "d11_owasp_lookup": (d11, D11_SQL),
    "d3_performance_scan": (
        _performance({False}),
        _performance_sql([r.rule_id for r in C.PERFORMANCE_RULES if r.window == 1])),
    "f8_line_windows": (
        _performance({True}),
        _performance_sql([r.rule_id for r in C.PERFORMANCE_RULES if r.window > 1])),
    "f1_line_numbers": (
        lambda spark, sf: R.explode_lines(code_files(spark, sf)).select(
            "file_id", "line_no", F.md5("line").alias("hash")),
        with_files("SELECT file_id, CAST(line_no AS INT) AS line_no, md5(line) AS hash FROM lines",
                   lines=True)),
    "p1_functions": (p1, P1_SQL),
    "p2_classes": (p2, P2_SQL),
    "p3_imports": (p3, P3_SQL),
    "p4_complexity": (p4, P4_SQL),
    "p5_call_edges": (p5, P5_SQL),
    "p5_resolved_calls": (p5_resolved, P5_RESOLVED_SQL),
    "d2_dangerous_definitions": (d2, D2_SQL),
    "d4_import_in_function": (d4, D4_SQL),
    "d5_covering_span": (d5, _with_lines(D5_SQL)),
    "b28_function_metrics": (b28, B28_SQL),
    "b29_nesting": (b29, B29_SQL),
    "c9_threshold_rules": (c9, C9_SQL),
    "b17_messages": (
        lambda spark, sf: c9(spark, sf).groupBy("rule_id", "message").agg(
            F.count(F.lit(1)).alias("n")),
        f"SELECT rule_id, message, count(*) AS n FROM ({C9_SQL}) GROUP BY ALL"),
    "f4_hot_paths": (f4, F4_SQL),
    "c8_file_errors": (c8, C8_SQL),
    "d6_taint_sources": (d6_sources, with_files(
        "SELECT file_id, name AS source_name, line AS source_line, col AS source_col, level,"
        " type AS source_type FROM sources", TAINT, lines=True)),
    "d6_taint_sinks": (d6_sinks, with_files(
        "SELECT file_id, name AS sink_name, line AS sink_line, col AS sink_col,"
        " type AS sink_type, required AS required_level FROM sinks", TAINT, lines=True)),
    "d7_taint_flows": (d7, with_files(
        "SELECT file_id, source_name, source_line, variable, sink_name, sink_line, sink_type"
        " FROM pairs", TAINT, FLOWS, lines=True)),
    "d8_tainted_variable": (d8, with_files(
        "SELECT file_id, name AS source_name, line AS source_line,"
        " coalesce(variable, '-') AS variable FROM sources", TAINT, lines=True)),
    "d9_flow_path": (d9, with_files(
        "SELECT file_id, source_name, source_line, sink_name, sink_line, flow_path, n_sanitizers,"
        " CASE WHEN n_sanitizers = 0 THEN 1 ELSE 0 END AS vulnerable FROM flows",
        TAINT, FLOWS, lines=True)),
    "d10_taint_findings": (d10, with_files(
        "SELECT file_id, path, vulnerability_type, severity, message, line_start, line_end,"
        " suggestion, cwe_id FROM taint_findings", TAINT, FLOWS, TAINT_FINDINGS, lines=True)),
}
