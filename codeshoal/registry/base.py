"""Shared views for the registered queries and their SQL twins.

``code_files`` turns every document into one source file: a small program
chosen by ``doc_id % 14`` and the document's whole text as comment lines, so
scans read all the text.  The expressions are valid in Spark SQL and in the
checking engine, which inlines them as a CTE.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import detect_language


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Timestamps of the tables carry no zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lines(*items: str) -> str:
    return "concat(" + ", chr(10), ".join(items) + ")"


_ID = "cast(doc_id AS varchar(20))"


def _prog(ext: str, prefix: str, *items: str) -> tuple[str, str]:
    """Extension and content: the program, then the text as comments."""
    text = f"concat('{prefix}', replace(text, chr(10), concat(chr(10), '{prefix}')))"
    return ext, _lines(*items, text)


PROGRAMS: list[tuple[str, str]] = [
    _prog(".py", "# ",
          "'DEBUG = True'",
          f"concat('def q', {_ID}, '(cursor, uid):')",
          "'    cursor.execute(\"select * from t where id = %s\" % uid)'",
          "'    return cursor'"),
    _prog(".py", "# ",
          f"concat('def load', {_ID}, '(data):')",
          "'    import pickle'",
          "'    return pickle.loads(data), eval(data)'"),
    _prog(".py", "# ",
          f"concat('def run', {_ID}, '():')",
          "'    cmd = input()'",
          "'    os.system(\"ls %s\" % cmd)'"),
    _prog(".py", "# ",
          f"concat('def safe', {_ID}, '():')",
          "'    cmd = request.args.get(0)'",
          "'    cmd = shlex.quote(cmd)'",
          "'    os.system(cmd)'"),
    _prog(".js", "// ",
          f"concat('function f', {_ID}, '(req) {{')".replace("{{", "{"),
          "'  console.log(req);'",
          "'  var a = req.query;'",
          "'  el.innerHTML = a;'",
          "'}'"),
    _prog(".java", "// ",
          "'import java.util.List;'",
          f"concat('class C', {_ID}, ' {{')".replace("{{", "{"),
          "'  String h(String s) { return md5(s); }'",
          "'  public int add(int a, int b) {'",
          "'    if (a > b) { return a; }'",
          "'    return a + b;'",
          "'  }'",
          "'}'"),
    _prog(".rb", "# ",
          f"concat('token = \"abcdefgh', {_ID}, '\"')",
          "'header \"Access-Control-Allow-Origin: *\"'"),
    _prog(".py", "# ",
          f"concat('def big', {_ID}, '(x):')",
          "concat(repeat(concat('    if x:', chr(10), '        x = 1', chr(10)),"
          " cast(doc_id % 63 AS int)), '    return x')"),
    _prog(".py", "# ",
          f"concat('def slow', {_ID}, '(d, xs):')",
          "'    out = [] + [1]'",
          "'    for x in xs:'",
          "'        out.append(x)'",
          "'    if x in d.keys() and x in xs:'",
          "'        pass'",
          "'    return out'"),
    (".xyz", "text"),
    _prog(".py", "# ",
          "'from os import path'",
          "'import sys'",
          "''",
          f"concat('class K', {_ID}, '(Base, Mixin):')",
          "'    \"\"\"Doc.'",
          "'    if this line were code it would count'",
          "'    \"\"\"'",
          "'    def __init__(self, a: int = 0) -> None:'",
          "'        self.a = a if a else 1'",
          "''",
          "'    def eval(self, rows):'",
          "'        s = \"\"'",
          "'        for r in rows:'",
          "'            s += r'",
          "'        def inner(z):'",
          "'            with z:'",
          "'                return self.a'",
          "'        x = self.a + 1'",
          "'        y = self.a + 2'",
          "'        z = self.a + 3'",
          f"concat('        return load', {_ID}, '(s)')",
          "''",
          f"concat('def helper', {_ID}, '(v):')",
          f"concat('    return K', {_ID}, '(v).eval(v)')"),
    _prog(".ts", "// ",
          "'import React from \"react\";'",
          f"concat('const el', {_ID}, ' = document.getElementById(\"a\");')",
          "'for (var i = 0; i < rows.length; i++) {'",
          "'  console.info(rows[i]);'",
          "'}'"),
    _prog(".go", "// ",
          "'package main'",
          "'import \"fmt\"'",
          f"concat('func G', {_ID}, '(a int) int {{')".replace("{{", "{"),
          "'  fmt.Println(a)'",
          "'  return a'",
          "'}'"),
    _prog(".js", "// ",
          "'import Lib from \"lib\";'",
          "'const fs = require(\"fs\");'",
          f"concat('class W', {_ID}, ' extends Base {{')".replace("{{", "{"),
          "'  run(a, b) {'",
          "'    if (a) {'",
          "'      while (b) { b--; }'",
          "'    }'",
          "'    return a;'",
          "'  }'",
          "'}'",
          "'const add = (a, b) => a + b;'"),
]

EXTENSIONS = "CASE doc_id % 14 " + " ".join(
    f"WHEN {i} THEN '{ext}'" for i, (ext, _) in enumerate(PROGRAMS)
) + " END"
CONTENT = "CASE doc_id % 14 " + " ".join(
    f"WHEN {i} THEN {body}" for i, (_, body) in enumerate(PROGRAMS)
) + " END"
REPO = "concat('repo', cast(doc_id % 5 AS varchar(20)))"
PATH = f"concat('src/', source, '/f', {_ID}, {EXTENSIONS})"


def code_files(spark: SparkSession, sf_dir: str, catalog: str = "scanner",
               by_key: bool = False) -> DataFrame:
    """(file_id, repo_id, path, language, content), one row per document.

    ``by_key`` deals the documents by their id, into as many tasks as their size asks for, so
    that a join on file_id does not deal the texts again.
    """
    documents = table(spark, sf_dir, "documents")
    # A small file is one row group; it is dealt out, as a large one is, at every size.
    dealt = documents.repartition("doc_id") if by_key else documents.repartition(
        spark.sparkContext.defaultParallelism)
    return (
        dealt
        .select(
            F.col("doc_id").alias("file_id"),
            F.expr(REPO).alias("repo_id"),
            F.expr(PATH).alias("path"),
            F.expr(CONTENT).alias("content"),
        )
        .withColumn("language", detect_language(F.col("path"), catalog))
    )


def sql_text(value: str) -> str:
    """A string literal for the checking engine (no backslash escapes there)."""
    parts = value.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


CODE_FILES = f"""code_files AS (
  SELECT doc_id AS file_id, {REPO} AS repo_id, {PATH} AS path, {CONTENT} AS content,
    CASE {EXTENSIONS} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript'
      WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go'
      WHEN '.rb' THEN 'ruby' END AS language
  FROM documents)"""
LINES = """lines AS (
  SELECT file_id, repo_id, path, language, line_no, a[line_no] AS line, a[line_no + 1] AS next1,
    a[line_no + 2] AS next2, len(a) AS n_lines
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS line_no
        FROM (SELECT *, string_split(content, chr(10)) AS a FROM code_files)))"""


def with_files(query: str, *more: str, lines: bool = False) -> str:
    """Prefix a query with the shared CTEs."""
    parts = [CODE_FILES] + ([LINES] if lines else []) + list(more)
    return "WITH " + ",\n".join(parts) + "\n" + query
