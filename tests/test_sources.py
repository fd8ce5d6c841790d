from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codeshoal.functions import languages as L
from codeshoal.functions import prompts as P
from codeshoal.functions import text as X
from codeshoal.operators import rules as R
from codeshoal.sources import corpora, sinks
from codeshoal.sources import files as SRC


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,scanner,extended", [
    ("test.py", "python", "python"), ("/path/to/file.py", "python", "python"),
    ("test.jsx", "javascript", "javascript"), ("a.h", "cpp", "c"), ("test.xyz", None, None),
    ("Dockerfile", None, "dockerfile"), ("x/Makefile", None, "makefile"), ("A.PY", "python", "python"),
    (".py", None, "python"), ("a.R", None, "r"), ("noext", None, None),
])
def test_languages(spark, path, scanner, extended):
    assert one(spark, L.detect_language(F.col("p")), p=path) == scanner
    assert one(spark, L.detect_language(F.col("p"), "extended"), p=path) == extended


@pytest.mark.parametrize("text,expected", [
    ("", (1, 0, 0)), ("a\n", (2, 1, 0)), ("\n\n", (3, 0, 0)), ("# c\ncode", (2, 1, 1)),
    ('"""one line"""\nstill\nend"""\ncode', (4, 1, 3)), ("/* a\n b\n*/\nx", (4, 1, 3)),
    ("* star\n// s\n'''\nq'''\nx", (5, 1, 4)),
])
def test_count_lines(spark, text, expected):
    assert tuple(one(spark, X.count_lines(F.col("t")), t=text)) == expected


def test_normalize_and_truncate(spark):
    code = 'x = 1  # c\n\n"""doc\nmore"""\n  y = 2\n'
    assert one(spark, X.normalize_code(F.col("t"), F.lit("python")), t=code) == "x = 1\ny = 2"
    js = "a(); // c\n/* b\n c */ d();"
    assert one(spark, X.normalize_code(F.col("t"), F.lit("javascript")), t=js) == "a();\nd();"
    long = one(spark, X.truncate_code(F.col("t"), 2, 100), t="a\nb\nc")
    assert long == "a\nb\n... [truncated]"
    assert one(spark, X.truncate_code(F.col("t"), 9, 3), t="abcdef") == "abc\n... [truncated]"


@pytest.mark.parametrize("url,expected", [
    ("https://host/o/r.git", ("host", "o", "r", "https")), ("http://h/o/r", ("h", "o", "r", "https")),
    ("https://h/o", (None, None, None, "https")), ("git@h:o/r.git", ("h", "o", "r", "ssh")),
    ("git@h:o", ("h", None, None, "ssh")), ("git@h", (None, None, None, "ssh")),
    ("ftp://h/o/r", (None, None, None, None)),
])
def test_git_urls(spark, url, expected):
    assert tuple(one(spark, X.parse_git_url(F.col("u")), u=url)) == expected


def test_formatting(spark):
    chat = spark.createDataFrame(
        [([("system", "a"), (None, "b"), ("user", None)],)],
        "messages array<struct<role:string,content:string>>")
    assert chat.select(X.format_chat(F.col("messages"))).first()[0] == (
        "<|system|>a<|user|>b<|user|>")
    assert one(spark, X.format_instruction(F.col("i"), F.lit(""), F.col("o")), i="I", o="O") == (
        "### Instruction:\nI\n### Response:\nO")


def test_output_parsing(spark):
    plain = '{"issues": [{"type": "a"}], "overall_score": 7}'
    fenced = "text\n```json\n" + plain + "\n```\n"
    for text, n, score in ((plain, 1, 7), (fenced, 1, 7), ("nothing", 0, 50), ("{broken", 0, 50)):
        parsed = P.parse_output(F.col("t"), "performance")
        assert one(spark, P.items_found(parsed, "performance"), t=text) == n
        assert one(spark, P.overall_score(parsed), t=text) == score
    assert one(spark, P.parse_output(F.col("t"), "fix")["fixed_code"], t="code") == "code"
    assert one(spark, P.completion_prompt(F.col("a"), F.col("b")), a="x", b="") == "x"


def test_tree_scan(spark, tmp_path):
    tree = {
        "src/a.py": b"eval(x)\n", "src/b.bin": b"ab\x00cd", "src/bad.py": b"x = '\xff\xfeok'\n",
        ".git/c.py": b"eval(x)", "node_modules/d.js": b"eval(x)", "e.xyz": b"text",
        "src/.hidden/f.py": b"eval(y)", "src/pkg/deep/er/__init__.py": b"import os\n",
    }
    for name, data in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = SRC.read_tree(spark, str(tmp_path), "r")
    got = {r["path"]: r for r in files.collect()}
    assert sorted(got) == [
        "e.xyz", "src/a.py", "src/b.bin", "src/bad.py", "src/pkg/deep/er/__init__.py"]
    assert got["src/b.bin"]["error"] == "binary file" and got["src/b.bin"]["content"] is None
    assert got["src/bad.py"]["content"] == "x = 'ok'\n"
    only = SRC.read_tree(spark, str(tmp_path), "r", include_patterns=["*.py"])
    assert sorted(r["path"] for r in only.collect()) == [
        "src/a.py", "src/bad.py", "src/pkg/deep/er/__init__.py"]
    assert SRC.read_tree(spark, str(tmp_path), "r", skip_rules=False).count() == len(tree)
    assert R.security_scan(files).count() == 1
    assert SRC.file_errors(files).select("path").distinct().count() == 2
    out = str(tmp_path / "out")
    sinks.write_findings(R.security_scan(files), out)
    assert spark.read.parquet(out).filter("finding_type = 'security'").count() == 1


def test_corpus_sources(spark, tmp_path):
    rows = [{"k": 1, "t": "a"}, {"k": 2, "t": "b\nc"}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "b.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"k": [1, 2], "t": ["a", "b\nc"]}, indent=1))
    for name in ("a.jsonl", "b.json", "c.json"):
        df = corpora.load_source(spark, str(tmp_path / name))
        assert sorted((r["k"], r["t"]) for r in df.collect()) == [(1, "a"), (2, "b\nc")]
    with pytest.warns(UserWarning):
        assert corpora.load_source(spark, str(tmp_path / "none.jsonl")) is None
    with pytest.raises(FileNotFoundError):
        corpora.load_preferences(spark, str(tmp_path / "none.jsonl"))
    assert corpora.load_preferences(spark, str(tmp_path / "a.jsonl")).count() == 2


def test_mime_types(spark):
    df = spark.createDataFrame(
        [("a.py",), ("b.tar.gz",), ("c.tgz",), ("d",), ("e.JSON",)], "path string")
    import mimetypes

    standard = mimetypes.MimeTypes(filenames=())
    for row in L.with_mime_type(df).collect():
        want = standard.guess_type(row["path"])[0] or "application/octet-stream"
        assert row["mime"] == want, row
