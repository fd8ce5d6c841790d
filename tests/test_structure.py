from __future__ import annotations

import time
import ast
import random
import re

from pyspark.sql import functions as F

from codeshoal.functions.bind import removed
from codeshoal.operators import metrics as M
from codeshoal.operators import structure as S

PYTHON = '''import os
from a.b import c as d, e
from . import f


@decorator
def first(
    a,
    b: int,
    *args,
    c=1,
    d: str = "x",
) -> Dict[str, int]:
    """Doc: if this counted, it would be wrong.

for also not
    """
    # while neither
    if a:
        return 1
    elif b:
        return 2
    return 3 if c else 4


class Base:
    pass


class Child(Base, metaclass=M):
    @property
    def hidden(self):
        return "def nothing(): if"

    async def run(self, x):
        async with x:
            def inner(y):
                assert y
        for i in x:
            try:
                pass
            except E:
                continue
        return self

def tail(): return 1
'''


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def expected_python(text):
    """Spans and complexities by the language's own parser."""
    decisions = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With,
                 ast.AsyncWith, ast.Assert, ast.IfExp)
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = [n for n in ast.walk(node) if isinstance(n, decisions)]
            elifs = [
                n.orelse[0] for n in inner if isinstance(n, ast.If) and len(n.orelse) == 1
                and isinstance(n.orelse[0], ast.If)
                and text.split("\n")[n.orelse[0].lineno - 1].strip().startswith("elif")
            ]
            out.append((node.name, node.lineno, node.end_lineno, 1 + len(inner) - len(elifs)))
    return sorted(out)


def test_python_functions_agree_with_a_parser(make_files):
    got = S.functions(make_files({"a.py": PYTHON}))
    assert rows(got, "name", "start_line", "end_line", "complexity") == expected_python(PYTHON)


def test_own_sources_agree_with_a_parser(make_files):
    """Real code: the modules of this package."""
    import codeshoal.operators.corpus as corpus
    import codeshoal.operators.graph as graph
    import codeshoal.operators.requests as requests
    import codeshoal.session as session

    for module in (corpus, graph, requests, session):
        text = open(module.__file__).read()
        got = rows(S.functions(make_files({"m.py": text})),
                   "name", "start_line", "end_line", "complexity")
        want = expected_python(text)
        assert [r[:3] for r in got] == [r[:3] for r in want], module.__name__


def test_python_parameters_and_return_types(make_files):
    got = {r["name"]: r for r in S.functions(make_files({"a.py": PYTHON})).collect()}
    assert got["first"]["parameters"] == ["a", "b: int", "c=1"]
    assert got["first"]["return_type"] == "Dict[str, int]"
    assert got["run"]["parameters"] == ["self", "x"]
    assert got["tail"]["return_type"] is None


def test_python_classes(make_files):
    got = {r["name"]: r for r in S.classes(make_files({"a.py": PYTHON})).collect()}
    assert got["Child"]["parent_classes"] == ["Base"]
    assert [m["name"] for m in got["Child"]["methods"]] == ["run"]
    assert (got["Base"]["start_line"], got["Base"]["end_line"]) == (26, 27)


def test_imports(make_files):
    files = make_files({
        "a.py": PYTHON, "b.js": "import X, { y } from './m';\nimport 'side';\n",
        "c.py": '"""\nimport nothing\n"""\nimport os.path as p, sys',
    })
    assert rows(S.imports(files), "path", "line_no", "module", "names", "is_from_import") == [
        ("a.py", 1, "os", [], False), ("a.py", 2, "a.b", ["c", "e"], True),
        ("a.py", 3, ".", ["f"], True), ("b.js", 1, "./m", ["X"], True),
        ("b.js", 2, "side", [], True), ("c.py", 4, "os.path", ["sys"], False),
    ]


def test_javascript(make_files):
    text = """function greet(name) {
    return `Hello, ${name}! {{`;
}

const add = (a, b) => a + b;
class A extends B {
  /* if (x) { */
  static run(a, { b }) {
    if (a) { for (let i = 0; i < 3; i++) { go("{"); } }
    else if (b) { while (b) {} }
    do { a--; } while (a);
    for (const x of b) {}
    return [1].map(x => {
      return x;
    });
  }
}
"""
    files = make_files({"a.js": text})
    assert rows(S.functions(files), "name", "start_line", "end_line", "parameters", "complexity") == [
        ("<anonymous>", 5, 5, ["a", "b"], 1), ("<anonymous>", 13, 15, [], 1),
        ("greet", 1, 3, ["name"], 1), ("run", 8, 16, ["a"], 5),
    ]
    row = S.classes(files).first()
    assert (row["name"], row["parent_classes"], row["end_line"]) == ("A", ["B"], 17)
    assert [m["name"] for m in row["methods"]] == ["run"]


def test_java_and_go(make_files):
    files = make_files({
        "A.java": "public class A {\n  @Override\n  public Map<String, Integer> get(String a, int... b)"
                  "\n  {\n    if (a == null) { return null; }\n    return new Map(a);\n  }\n"
                  "  abstract void none();\n}\n",
        "a.go": "package a\n\nfunc Run(a int) {\n\tif a { b() }\n}\n\nfunc (t T) Not() {\n}\n",
    })
    assert rows(S.functions(files), "name", "start_line", "end_line", "complexity") == [
        ("Run", 3, 5, 1), ("get", 3, 7, 1), ("none", 8, 8, 1)]
    got = {r["name"]: r for r in S.functions(files).collect()}
    assert got["get"]["parameters"] == ["String a"]
    assert got["get"]["return_type"] == "Map<String, Integer>"


def test_covering_and_dangerous(make_files, spark):
    files = make_files({"a.py": PYTHON, "b.py": "def eval(x):\n    pass\n"})
    asked = spark.createDataFrame([(0, 1), (0, 37), (0, 99)], "file_id bigint, line_no int")
    got = S.covering(S.covering(asked, files), files, "class")
    assert rows(got, "line_no", "function", "class") == [
        (1, None, None), (37, "run", "Child"), (99, None, None)]
    assert rows(S.dangerous_definitions(files), "path", "rule_id") == [("b.py", "CS-AST001")]


def test_metrics(make_files):
    body = "".join(f"    if x == {i}:\n        pass\n" for i in range(60))
    files = make_files({"a.py": f"def big(x):\n{body}\ndef one(): pass\ndef one():\n    return 2\n"})
    metrics = M.function_metrics(S.functions(files))
    assert rows(M.threshold_findings(metrics), "rule_id") == [
        ("PERF-C001",), ("PERF-N001",), ("PERF-S001",)]
    by_line = {r["start_line"]: r for r in metrics.filter("name = 'one'").collect()}
    first = min(by_line)
    assert by_line[first]["maintainability"] == 100.0
    assert rows(M.last_by_name(metrics), "name") == [("big",), ("one",)]
    assert rows(M.hot_paths(metrics, 1), "name", "rank") == [("big", 1)]


def test_call_edges_resolve_once(make_files):
    files = make_files({
        "a.py": "def f():\n    g()\n    h()\n\ndef g():\n    g()\n",
        "b.py": "def g():\n    pass\ndef h():\n    f()\n", "c.py": "def h():\n    unknown()\n",
    })
    edges = S.call_edges(files)
    key = lambda p, n: F.md5(F.lit(f"r:{p}:{n}"))
    names = {
        files.sparkSession.range(1).select(key(p, n)).first()[0]: f"{p}:{n}"
        for p, n in [("a.py", "f"), ("a.py", "g"), ("b.py", "g"), ("b.py", "h"), ("c.py", "h")]
    }
    assert sorted((names[r["src"]], names[r["dst"]]) for r in edges.collect()) == [
        ("a.py:f", "a.py:g"), ("a.py:f", "b.py:h"), ("a.py:g", "a.py:g"), ("b.py:h", "a.py:f")]


MISLEADING_PYTHON = """# uses ''' quotes, and it's fine
x = "# no comment: '''"


def outer(a):
    '''A docstring that holds \\"\\"\\" and

    def phantom(): if a: while a:
    '''
    # don't open a string: \"\"\" or '
    url = 'http://x/#a\\\\'  # "
    return 1 if a else 2


def last(b):
    return f"{b}'"
"""

MISLEADING_JS = r"""// build src/*.js, don't stop
function first(a) {
  const re = /\/\*["'`{]/;  // "
  const cls = a.match(/[/"{]/g);
  if (a) { return `x ${a} { // no comment /* nor this
    function phantom() {`; }
  return "/*" + '//' + a / 2 / 3;
}
/* it's a block, with `one mark
function gone() { */
function second(b) {
  return /'/.test(b) ? 1 : 2;
}
"""

MISLEADING_JAVA = r"""// src/*.java isn't a block
class A {
  char quote = '"', back = '\\', single = '\'';
  int one(int a) { // "
    if (a > 0) { return 1; }
    return "/*".length();
  }
  /* a " in a block */
  int two() {
    return 2;
  }
}
"""


def test_marks_in_comments_strings_and_patterns_open_nothing(make_files):
    got = S.functions(make_files({"a.py": MISLEADING_PYTHON}))
    assert rows(got, "name", "start_line", "end_line", "complexity") == expected_python(
        MISLEADING_PYTHON)
    got = S.functions(make_files({"a.js": MISLEADING_JS}))
    assert rows(got, "name", "start_line", "end_line") == [("first", 2, 8), ("second", 11, 13)]
    got = S.functions(make_files({"A.java": MISLEADING_JAVA}))
    assert rows(got, "name", "start_line", "end_line") == [("one", 4, 7), ("two", 9, 11)]


def test_long_tokens_need_no_deep_stack(make_files):
    body = "a" * 300_000
    text = f'/* {body} */\nfunction f(a) {{\n  const s = "{body}", r = /{body}/, t = `{body}`;\n}}\n'
    got = S.functions(make_files({"a.js": text}))
    assert rows(got, "name", "start_line", "end_line") == [("f", 2, 4)]


LITERALS_JS = r"""
/[`]/.test(name);
const R = [
  /[/*]/,
      /`/,  // a mark: `
  // one's own line
  /["']/,
  /* and */ /[{/]/
];
function a(x) {
  return x.replace(
    /`/g,
    "",
  ).match(y => /[/*]/.test(y)) ||
                                                                                /[`{]/.exec(x);
}
const n = x++ / 2 / 3, t = total /* all
function hidden() { */ / count, u = w / "/*".length;
function b() {
  return typeof/[{`]/ + /["]/.source;
}
"""


def test_regex_literals_on_their_own_lines_open_nothing(make_files):
    many = "const all = /" + "[/*`]" * 60 + "/;\nfunction c() {\n}\n"
    far = "const far =" + " \n" * 300 + "/[/*`]/;\nfunction d() {\n}\n"
    start = "/[`]/.test(name);\nfunction e() {\n}\n"
    got = S.functions(make_files({
        "a.js": LITERALS_JS, "c.js": many, "d.js": far, "e.js": start}))
    assert rows(got, "name", "start_line", "end_line") == [
        ("<anonymous>", 14, 14), ("a", 10, 16), ("b", 19, 21), ("c", 2, 3), ("d", 302, 303), ("e", 2, 3)]


SEVERAL = {
    "a.js": "function one() {}\nif (x) /[/*]/.test(y);\nfunction two() {}\n",
    "b.js": "foo(a) / 2 /* c */; function five() {}\n",
    "c.js": "class A { m() { return 1; } n(b) { if (b) { return 2; } } } function f({a, b} = {}) "
            "{ return a; } const g = (x) => { return x; };\n",
    "d.js": 'const t = `a ${ `b ${ c } /*` } {`;\nfunction k() { return `x`; }\n'
            'while (a(")")) /`/.test(b);\nfunction z() {\n  do { x(); } while (y);\n}\n',
    "e.js": "x = a / b; function q() { return c / d; }\n"
            "if (p) { r(); } else if (s) { t(); } else { u(); }\n"
            "for (var i = 0; i < n; i++) { v(function() { w(); }); }\n"
            "try { a(); } catch (e) { b(); }\nfunction h() {\n}\n",
    "f.java": "class C { int a(int x) { return x; } abstract void b(); "
              "String c() { for (int i = 0; i < 3; i++) { } return s; } }\n",
    "g.go": "func A() int { return 1 }\nfunc B(x int) (int, error) {\n"
            "  if x > 0 { return 1, nil }\n  return 0, nil\n}\n",
    "h.js": "with (o) /'/.test(p); function v() {}\nfor (const k of `}`) /\"/.test(k);\n"
            "function w() {}\n",
}


def test_several_definitions_and_control_heads_on_a_line(make_files):
    files = make_files(SEVERAL)
    got = sorted((r.path, r.start_line, r.end_line, r.name, tuple(r.parameters), r.complexity)
                 for r in S.functions(files).collect())
    assert got == sorted([
        ("a.js", 1, 1, "one", (), 1), ("a.js", 3, 3, "two", (), 1), ("b.js", 1, 1, "five", (), 1),
        ("c.js", 1, 1, "m", (), 1), ("c.js", 1, 1, "n", ("b",), 2), ("c.js", 1, 1, "f", (), 1),
        ("c.js", 1, 1, "<anonymous>", ("x",), 1), ("d.js", 2, 2, "k", (), 1),
        ("d.js", 4, 6, "z", (), 1), ("e.js", 1, 1, "q", (), 1), ("e.js", 3, 3, "<anonymous>", (), 1),
        ("e.js", 5, 6, "h", (), 1), ("f.java", 1, 1, "a", ("int x",), 1),
        ("f.java", 1, 1, "b", (), 1), ("f.java", 1, 1, "c", (), 1), ("g.go", 1, 1, "A", (), 1),
        ("g.go", 2, 5, "B", (), 1), ("h.js", 1, 1, "v", (), 1), ("h.js", 3, 3, "w", (), 1)])
    classes = {r.name: [m.name for m in r.methods] for r in S.classes(files).collect()}
    assert classes["A"] == ["m", "n"]


def test_long_lines_stay_linear(make_files):
    minified = "!function(e){" + "function a(b,c){return b?c(b,(d,e)):{x:1}};" * 20_000 + "}(this);"
    files = make_files({
        "min.js": minified, "open.js": "f(" * 30_000 + "\nfunction g() {}\n",
        "ticks.js": "x = `${`" * 20_000 + "\n", "ifs.js": "if (a) b / c; " * 30_000})
    began = time.perf_counter()
    counted = {r.path: r["count"] for r in S.functions(files).groupBy("path").count().collect()}
    assert counted["min.js"] > 0 and time.perf_counter() - began < 60


def test_masks_of_random_texts(spark):
    """As ``re`` finds the tokens, also in a text that holds the mark set around them."""
    def masked(text, tokens):
        def blank(found):
            token = found[0]
            several = token[:3] in ('"""', "'''")
            if token[0] == "#" or token[:2] == "//":
                return ""
            lines = "\n" * token.count("\n")
            if token[:2] == "/*":
                return lines
            return '""' + lines + (S.RESUMED if several else "")

        return re.sub(tokens, blank, re.sub(r"\\.", "_", text))

    strings = r'''"[^"\n]*"|'[^'\n]*\''''
    tokens = {
        "python": r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|" + strings + r"|#[^\n]*",
        "java": strings + r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)",
    }
    rng = random.Random(3)
    bits = ['"', "'", '"""', "'''", "#", "//", "/*", "*/", "\\", "\n", "\r", "\t", " ", "x(", "{}",
            "é", "$1", S.AROUND, S.RESUMED]
    texts = [("".join(rng.choices(bits[:rng.choice([-2, None])], k=rng.randint(0, 30))),)
             for _ in range(2000)]
    got = spark.createDataFrame(texts, "text string").select(
        "text", *(S.mask(F.col("text"), F.lit(name)).alias(name) for name in tokens)).collect()
    assert sum(S.AROUND in row.text for row in got) > 100
    for row in got:
        assert {name: row[name] for name in tokens} == {
            name: masked(row.text, found) for name, found in tokens.items()}


def test_brackets_and_blanks_are_counted(spark):
    texts = [(t,) for t in ("", "([{", ")]}x(", "é{{}", None)]
    got = spark.createDataFrame(texts, "t string").select(
        removed(F.col("t"), "([{"), removed(F.col("t"), "{")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (3, 1), (1, 0), (2, 2), (None, None)]
