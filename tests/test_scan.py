from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeshoal import catalogs as C
from codeshoal.operators import findings as FN
from codeshoal.operators import rules as R
from codeshoal.operators import taint as T
from codeshoal.plans import analysis as A


def found(df):
    return sorted((r["path"], r["rule_id"], r["line_start"]) for r in df.collect())


def test_snippets_of_the_rule_catalog(make_files):
    files = make_files({
        "a.py": 'API_KEY = "sk-1234567890abcdef"\npassword = "super_secret_password"\n',
        "b.py": "import pickle\n\ndef load_data(data):\n    return pickle.loads(data)\n",
        "c.js": "function show(input) {\n    document.innerHTML = input;\n}\n",
        "d.py": 'query = f"SELECT {x}"\ncursor.execute(query)\n',
        "e.xyz": 'password = "super_secret_password"',
        "empty.py": "",
    })
    assert found(R.security_scan(files)) == [
        ("a.py", "CS-S002", 1), ("a.py", "CS-S002", 2), ("b.py", "CS-S003", 4),
        ("c.js", "CS-S007", 2),
    ]


def test_columns_of_several_matches(make_files):
    files = make_files({"a.py": "eval(x) + EVAL (y)\n  md5(z)"})
    spans = sorted(
        (r["rule_id"], r["line_start"], r["column_start"], r["column_end"], r["code_snippet"])
        for r in R.security_scan(files).collect()
    )
    assert spans == [
        ("CS-S003", 1, 0, 5, "eval(x) + EVAL (y)"), ("CS-S003", 1, 10, 16, "eval(x) + EVAL (y)"),
        ("CS-S005", 2, 2, 6, "md5(z)"),
    ]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="evalxc( md5=\"'%s)DEBUGTrue\t", max_size=30), max_size=4))
def test_matches_agree_with_re(spark, make_files, lines):
    text = "\n".join(lines)
    expected = sorted(
        (rule.rule_id, n, m.start(), m.end())
        for rule in C.SECURITY_RULES if "*" in rule.languages or "python" in rule.languages
        for n, line in enumerate(text.split("\n"), 1)
        for m in re.finditer(rule.pattern, line, re.IGNORECASE)
    )
    got = R.security_scan(make_files({"a.py": text})).select(
        "rule_id", "line_start", "column_start", "column_end"
    )
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_performance_windows(make_files):
    files = make_files({
        "a.py": "for a in b:\n    c.append(a)\nfor x in y: \n    s += x\n\nfor z in w:",
        "b.py": "u = self.a\nv = self.a\nw = self.a\nz = other.b",
        "c.ts": "for (var i = 0; i < xs.length; i++) {\n  document.querySelector(i)\n}",
    })
    assert found(R.performance_scan(files)) == [
        ("a.py", "PERF-P002", 3), ("a.py", "PERF-P004", 1), ("b.py", "PERF-P005", 1),
        ("c.ts", "PERF-J001", 2), ("c.ts", "PERF-J003", 1),
    ]


def test_one_pass_equals_separate_scans(make_files):
    files = make_files({
        "a.py": "def eval(a):\n    import os\n    x = [] + [1]\n    return exec(a)\n",
        "b.js": "var q = req.query;\nconsole.log(q);\nel.innerHTML = q;\n",
    })
    every = A.analyze(files)
    parts = [A.analyze(files, [t]) for t in A.ANALYSES]
    columns = ["path", "rule_id", "line_start", "line_end", "message"]
    union = FN.union_findings(*parts).select(columns)
    assert every.select(columns).exceptAll(union).count() == 0
    assert union.exceptAll(every.select(columns)).count() == 0
    # Every finding lies on a line that exists.
    lines = R.explode_lines(files).select("path", F.col("line_no").alias("line_start"))
    assert every.join(lines, ["path", "line_start"], "left_anti").count() == 0


def test_user_rules_reject_broken_patterns(spark, make_files):
    rows = [("A", "a", r"foo\d", "low", None, "m", None, None, ["*"], True),
            ("B", "b", "(x", "low", None, "m", None, None, ["*"], True)]
    good, bad = R.validate_rules(spark.createDataFrame(rows, R.RULE_SCHEMA))
    assert [r.rule_id for r in good] == ["A"]
    assert [r["rule_id"] for r in bad.collect()] == ["B"]
    assert found(R.security_scan(make_files({"a.rb": "foo1 FOO2"}), good)) == [
        ("a.rb", "A", 1), ("a.rb", "A", 1)]


def flows(files, **options):
    return sorted(
        (r["source_line"], r["sink_name"], r["sink_line"], r["is_vulnerable"],
         [tuple(p) for p in r["flow_path"]], list(r["sanitizers"]))
        for r in T.taint_flows(files, **options).collect()
    )


def test_taint_paths_and_sanitizers(make_files):
    files = make_files({
        "a.py": "cmd = input()\nos.system(cmd)\ncmd = shlex.quote(cmd)\nos.system(cmd)",
        "b.py": "os.system(input())",
        "c.py": "x = foo\ninput()\nos.system(x)",
    })
    assert flows(files) == [
        (1, "os.system", 2, True, [(1, 7), (1, 1), (2, 1)], []),
        (1, "os.system", 4, False, [(1, 7), (1, 1), (2, 11), (3, 1), (4, 1)], ["shlex.quote"]),
    ]


def test_taint_options(make_files):
    files = make_files({"a.py": "v = os.environ.get('A')\nprint(v)\neval(v)"})
    # "print" contains "int", which counts as a sanitizer unless words are whole.
    assert [f[3] for f in flows(files)] == [False]
    assert [f[3] for f in flows(files, word_boundary=True)] == [True]
    assert [f[3] for f in flows(files, word_boundary=True, check_level=True)] == [False]


def test_taint_findings(make_files):
    files = make_files({"a.js": "var a = req.body;\nwindow.location = a;"})
    row = T.taint_findings(T.taint_flows(files)).first()
    assert (row["vulnerability_type"], row["cwe_id"], row["severity"]) == (
        "Open Redirect", "CWE-601", "high")
    assert row["message"] == (
        "Potential Open Redirect vulnerability: Untrusted data from 'req.body' (line 1) "
        "flows to 'window.location' (line 2)")


def test_policy_and_validation(make_files, spark):
    files = make_files({"src/a.py": 'eval(x)\ntoken = "abcdefghij"', "test/b.py": "eval(y)"})
    found_ = R.security_scan(files)
    kept = FN.apply_policy(found_, exclude_patterns=["test/*"])
    assert found(kept) == [("src/a.py", "CS-S003", 1)]
    assert found(FN.apply_policy(found_, confidence_threshold=0.1, include_patterns=["a.py"])) == [
        ("src/a.py", "CS-S002", 2), ("src/a.py", "CS-S003", 1)]
    rows = spark.createDataFrame([("x", 0.5), (None, 2.0)], "language string, confidence double")
    ok, bad = FN.validate(
        rows, {"language": F.col("language").isNotNull(), "confidence": F.col("confidence") <= 1})
    assert ok.count() == 1
    assert bad.first()["failed"] == ["language", "confidence"]


def test_report_round_trip(make_files, tmp_path, spark):
    from codeshoal.sources import sinks

    files = make_files({"a.py": "eval(x)\nmd5(y)\nmd5(z)"})
    report = FN.security_report(R.security_scan(files))
    row = report.first()
    assert row["by_severity"] == {"critical": 1, "medium": 2}
    assert row["top_vulnerabilities"] == ["CS-S003", "CS-S005"]
    assert row["compliant_a03"] and not row["compliant_a08"]
    sinks.export_report(report, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 1


def test_equal_snippets_count_alone(spark):
    rows = [("a.py", "python", "eval(x)"), ("a.py", "python", "eval(x)"), ("b.py", "python", "pass")]
    df = spark.createDataFrame(rows, "filename string, language string, code string")
    got = sorted((r["filename"], r["findings_count"]) for r in A.analyze_snippets(df).collect())
    assert got == [("a.py", 1), ("a.py", 1), ("b.py", 0)]


def test_vulnerable_flows_agree_with_full_flows(make_files):
    text = "\n".join(
        ["a = input()", "b = sys.argv", "os.system(a)", "b = float(b)", "eval(b)", "exec(a)",
         "a = input()", "open(a)"] * 3)
    files = make_files({"a.py": text, "b.js": "var q = prompt();\nel.innerHTML = q;"})
    columns = ["path", "source_name", "source_line", "variable", "sink_name", "sink_line"]
    for options in ({}, {"word_boundary": True}, {"check_level": True}):
        full = T.taint_flows(files, **options).filter("is_vulnerable").select(columns)
        lean = T.vulnerable_flows(files, **options).select(columns)
        assert full.count() > 0
        assert full.exceptAll(lean).count() == 0 and lean.exceptAll(full).count() == 0


def test_flows_without_paths_and_their_steps(make_files):
    text = "\n".join(
        ["a = input()", "b = sys.argv", "os.system(a)", "b = float(b)", "eval(b)", "exec(a)",
         "a = input()", "open(a)"] * 3)
    files = make_files({"a.py": text, "b.js": "var q = prompt();\nel.innerHTML = q;"})
    ends = ["path", "source_name", "source_line", "variable", "sink_name", "sink_line"]
    for options in ({}, {"word_boundary": True}, {"check_level": True}):
        full = T.taint_flows(files, **options)
        lean = T.taint_flows(files, paths=False, **options)
        columns = [*ends, "is_vulnerable"]
        assert lean.count() == full.count() > 0
        assert full.select(columns).exceptAll(lean.select(columns)).count() == 0
    steps = T.path_of(T.taint_flows(files, paths=False), T.flow_steps(files))
    got = {}
    for r in steps.orderBy("step_line").collect():
        got.setdefault(tuple(r[c] for c in ends), []).append((r["step_line"], r["step_col"]))
    expected = {tuple(r[c] for c in ends): [tuple(p) for p in r["flow_path"]][1:-1]
                for r in T.taint_flows(files).collect()}
    assert got == {k: v for k, v in expected.items() if v}


def test_many_sources_and_sinks_in_a_file(make_files):
    text = "\n".join(["a = input()"] * 1500 + ["eval(a)"] * 1500)
    assert T.taint_flows(make_files({"a.py": text}), paths=False).count() == 1500 * 1500
