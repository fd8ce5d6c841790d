"""Thousands of user rules through an automaton: the rows of one rule after the other."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codeshoal.catalogs import PERFORMANCE_RULES, SECURITY_RULES, LineRule
from codeshoal.operators import rules as R

PART = st.sampled_from(
    ["abc", "k", "foo_", r"\(", r"\.", ".", r"\w+", r"\s*", "[a-c]", "[^x]]", "x?", "y+", "z*", "ab{2}",
     "c{0,2}", "(de)", "(?:gh)?", "(i|jk)+", "(?=l)", "(?<!m)", "^", "q$", "Rs"])


def rule(i, pattern, languages=("*",), gate=""):
    return LineRule(f"U{i}", f"n{i}", "low", "m", "r", languages, pattern, gate, "high", "CWE-89")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, min_size=1, max_size=6).map("".join), st.data())
def test_every_match_holds_the_required_text(pattern, data):
    literal = R.required_literal(pattern)
    compiled = re.compile(pattern)
    if literal and not set("^$") & set(pattern) and "(?" not in pattern:
        assert literal in data.draw(st.from_regex(compiled, fullmatch=True)).lower()


def test_unusual_patterns_have_no_required_text():
    for pattern in ("abc|def", r"\x41bcd", "(?i)abcd", r"\Qabc\E", r"\p{Lu}abc", "[[a]b]cde", "(abcd",
                    "[]a]bcd", "[a&&b]cde", "abcd|"):
        assert R.required_literal(pattern) == ""
    assert R.required_literal(r"return\s+foo\(bar") == "foo(bar"
    assert R.required_literal(r"Caf\w?eval\(x?") == "eval("


def test_many_rules_give_the_rows_of_unrolled_ones(spark, make_files):
    rng = random.Random(4)
    words = ["load", "Eval", "query", "key", "task", "İndex", "ſave", "Key", "straße", "x"]
    texts = {
        f"f{i}{rng.choice(['.py', '.js', '.txt'])}": "\n".join(
            " ".join(f"{rng.choice(words)}{rng.randrange(30)}(" for _ in range(rng.randrange(6)))
            for _ in range(rng.randrange(12)))
        for i in range(25)
    }
    files = make_files(texts)
    patterns = [rf"{w}{n}\(" for w in ("load", "eval", "index", "save", "key", "straße") for n in range(30)]
    patterns += [r"\w+7\(", "load|eval", "(?:query)1", r"QUERY\d+\( ?", r"task\d{1,2}", "^load", "", r"x\b"]
    many = tuple(rule(i, p, rng.choice([("*",), ("python",), ("python", "javascript")]))
                 for i, p in enumerate(patterns))
    many += tuple(SECURITY_RULES) + tuple(PERFORMANCE_RULES)
    expected = rows(R._scan_unrolled(files, many))
    assert len(expected) > 300
    found = R.scan_many(files, many)
    assert rows(found) == expected
    assert found.columns == R._scan_unrolled(files, many).columns


def test_five_thousand_rules_are_one_pass(spark, make_files):
    files = make_files({"a.py": "name17(x)\nname4999(name3)\nname3", "b.js": "NAME3( name3(", "c.py": ""})
    many = [rule(i, rf"name{i}\(") for i in range(5000)]
    found = R.scan(files, many)
    assert sorted((r["rule_id"], r["path"], r["line_start"], r["column_start"]) for r in found.collect()) == [
        ("U17", "a.py", 1, 0), ("U3", "b.js", 1, 0), ("U3", "b.js", 1, 7), ("U4999", "a.py", 2, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
