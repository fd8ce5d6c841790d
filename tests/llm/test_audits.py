"""Source divergence, hard negatives and quality rules next to brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest

from codeshoal.llm import divergence, negatives, quality, spans

DOCS = "doc_id long, text string, lang string, source string, n int, Term string, rank int"


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, s, 7, "x", 8) for i, t, lang, s in rows], DOCS)


ODD = [
    (1, "The cat sat\non the mat", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
    (3, "", "en", "a"), (None, "no id the cat", "de", "b"), (5, "the cat " * 9000, "en", ""),
    (6, "x" * 50_000 + " the", None, "b"), (7, " \t\n ", "fr", None), (8, "ÉTÉ été the", "en", "c"),
    (9, "été, the cat", "en", "c"), (9, "été, the cat", "en", "c"), (10, "\0the\0cat", "de", "a"),
]


def test_pointers_sort_like_bytes(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(divergence, "SYMBOLS", 2)
    for _ in range(200):
        words = [bytes(rng.choice(list(b"ab\xc3"), int(n)).tolist()) for n in
                 rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 40], int(rng.integers(0, 30)))]
        words += [words[i] for i in rng.integers(0, len(words), 20)] if words else []
        data = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends, _ = spans.tokens(data, np.array([0, len(data)]), spans.LETTER)
        order, run = divergence.sort_pointers(data, starts, ends)
        got = [data[a:b].tobytes() for a, b in zip(starts[order], ends[order])]
        distinct = sorted(set(words))
        assert got == sorted(words)
        assert run.tolist() == [distinct.index(w) for w in got]


def test_tokens_stay_in_their_rows():
    column = pa.array(["ab", "cd", None, "", " e", "f g", "é"])
    data, offsets = spans.text_bytes(column)
    starts, ends, row = spans.tokens(data, offsets, spans.LETTER)
    assert [(data[a:b].tobytes().decode(), r) for a, b, r in zip(starts, ends, row.tolist())] == [
        ("ab", 0), ("cd", 1), ("e", 4), ("f", 5), ("g", 5), ("é", 6)]
    data, offsets = spans.text_bytes(column.slice(1, 5))
    assert data.tobytes() == b"cd ef g" and offsets.tolist() == [0, 2, 2, 2, 4, 7]
    assert list(spans.slices(np.array([5, 1, 1, 9, 0, 2]), 3)) == [(0, 1), (1, 3), (3, 4), (4, 6)]


def divergence_brute(rows, least, top):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        held[lang].update(set(terms))
        count[lang, source].update(terms)
        groups[lang].add(source)
    found = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}

        def share(n, all_n):
            return 1 + 1_000_000_000 * (n + 5) // (all_n + 5 * len(kept))

        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            term = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                found |= {(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(ranked)}
    return found


@pytest.mark.parametrize("side", [128, 2])
def test_divergence_matches_brute_force(spark, monkeypatch, side):
    rng = np.random.default_rng(2)
    rows = ODD + [(100 + i, " ".join(f"w{'abcdefgh'[int(x)]}" for x in rng.integers(0, 8, 12)),
                   ["en", "de"][i % 2], f"s{i % 7}") for i in range(60)]
    docs = documents(spark, rows)
    if side == 2:
        # Small blocks and slices, so that every path is taken (tasks run in forked workers).
        monkeypatch.setattr(divergence, "SIDE", 2)
        monkeypatch.setattr(divergence, "TERMS", 3)
    got = {(r.lang, r.source, r.part, r.item, r.value, r.rank)
           for r in divergence.divergence(docs, 2, 4).collect()}
    assert got == divergence_brute(rows, 2, 4)
    assert divergence.divergence(documents(spark, [])).count() == 0
    none_kept = divergence.divergence(docs, 10 ** 6).collect()
    assert {(r.part, r.value) for r in none_kept} == {("pair", 0)}


def test_long_documents_count_once(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 50)
    batch = pa.RecordBatch.from_pydict({
        "lang": ["en"] * 3, "source": ["a", "a", "b"],
        "text": ["Cat dog " * 40, "cat", "x" * 300 + " cat"]})
    got = Counter()
    docs = Counter()
    for part in divergence._shards(iter([batch])):
        for r in part.to_pylist():
            got[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert got == {("a", "cat"): 41, ("a", "dog"): 40, ("b", "x" * 300): 1, ("b", "cat"): 1}
    assert docs == {("a", "cat"): 2, ("a", "dog"): 1, ("b", "x" * 300): 1, ("b", "cat"): 1}


def negatives_brute(rows, is_anchor, positives, most):
    rows = [(i, label, [floor(256 * x) for x in v]) for i, label, v in rows
            if label is not None and v is not None
            and all(x is not None and isfinite(x) for x in v)]
    limit = 2 ** 63 - 1
    found = []
    for a, (i, label, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = sorted(
            (-max(-limit, min(limit, sum(x * y for x, y in zip(v, w)))),
             j if j is not None else limit, b, other == label)
            for b, (j, other, w) in enumerate(rows) if b != a and len(w) == len(v))
        for p in [s for s in scored if s[3]][:positives]:
            hard = [s for s in scored if not s[3]
                    and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:most]
            found += [(i, p[1], r + 1, s[1], -p[0], -s[0]) for r, s in enumerate(hard)]
    return sorted(found)


def test_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, int(i % 3), (centres[i % 6] + rng.normal(0, 0.3, 8)).tolist()) for i in range(400)]
    rows += [(400 + i, 1, rows[0][2]) for i in range(60)]
    rows += [(500, None, [1.0] * 8), (501, 1, None), (502, 1, [1.0, None] * 4),
             (503, 1, [float("nan")] * 8), (504, 1, [float("inf")] * 8), (0, 2, rows[0][2]),
             (506, 1, [0.0] * 8), (507, 0, [3e30, -1e9, 0.0, 1.0] * 2), (508, 1, [1e30] * 8),
             (550, 2, [2e30] * 8), (600, 1, [1.0, 2.0]), (601, 1, [1.0, 2.5]), (602, 0, [1.0, 1.0]),
             (610, 1, []), (611, 2, [])]
    frame = spark.createDataFrame(
        [(i, v, label, 5, 6) for i, label, v in rows],
        "vec_id long, embedding array<double>, label int, uid int, Block int").coalesce(1)
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "TREE", 4)
    got = sorted(tuple(r) for r in negatives.mine_negatives(
        frame, frame.vec_id % 10 == 0, 4, 3).collect())
    assert got == negatives_brute(rows, lambda i: i % 10 == 0, 4, 3)
    assert negatives.mine_negatives(frame.limit(0), frame.vec_id % 10 == 0).count() == 0


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (40, 16))
    points = (centres[rng.integers(0, 40, 2000)] + rng.normal(0, 0.02, (2000, 16)))
    scores = negatives.Scores(points[:200], points, 256)
    whole = np.floor(256 * points).astype(np.int64)

    def overlaps(anchor, which, low, high):
        exact = whole[which] @ whole[anchor]
        assert (low <= exact).all() and (exact <= high).all()
        return high >= np.sort(low)[-30]

    for anchor, which, found in scores.rescored(overlaps):
        exact = whole @ whole[anchor]
        assert (found == exact[which]).all()
        assert np.sort(found)[-30:].tolist() == np.sort(exact)[-30:].tolist()
    assert scores.scored < 0.5 * 200 * 2000


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (40, 3))
    order, parent, edges = negatives.spanning_tree(points)
    place = {x: i for i, x in enumerate(order)}
    assert sorted(order) == list(range(40)) and parent.count(-1) == 1
    assert all(p < 0 or place[p] < place[i] for i, p in enumerate(parent))
    root, total = list(range(40)), 0.0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, i, j in sorted((float(np.linalg.norm(points[i] - points[j])), i, j)
                          for i in range(40) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert edges.sum() == pytest.approx(total)


def quality_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


CLEAN = "Several plain words make one honest sentence that says something."
JUNK = {
    "word_length": "a bc d ef g hi j kl m no p qr s tu v wx y za bc de fg hi",
    "symbols": " ".join(f"word{i}###" for i in range(30)),
    "repeated_lines": "\n".join(["one line is here"] * 3 + [f"other line {i}" for i in range(2)] * 4),
    "stammer": " ".join(w for x in "alpha beta gamma delta epsi zeta etaa thet iota kapp".split()
                        for w in [x] * 4),
    "without_letters": " ".join(str(1000 + i) for i in range(30)),
    "capitals": " ".join(f"SHOUT{chr(65 + i)}XY" for i in range(25)),
    "list_items": "\n".join(f"- entry {w} of these" for w in "abcdefghijkl"),
    "cut_off": "\n".join(f"line {w} goes on and on ..." for w in "abcdefghij"),
}
QUALITY_ODD = [
    None, "", " \n\t", "\n\na\n\na", "é ü\nü\x0bü\nü", "a b c d e f g h " * 3, "a b c d e f g\nh",
    "\0 \0", "w " * 200_000, "line of text\n" * 20_000,
    " ".join(f"sound{i}word" for i in range(60)), *JUNK.values(),
]


def test_quality_counts_match_brute_force(spark):
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(QUALITY_ODD)] +
                     [(3, QUALITY_ODD[3], "en", "a"), (None, CLEAN, "en", "a")])
    got = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r)[6:]) for r in
                 quality.quality_verdicts(docs.withColumn("KEPT", docs.n)).collect())
    texts = {r.doc_id if r.doc_id is not None else -1: r.text for r in docs.collect()}
    assert len(got) == len(QUALITY_ODD) + 2
    for i, row in got:
        assert row[:6] == quality_brute(texts[i])
        assert row[6] == (row[7] is None) and (not row[5] or row[7] == "base")
    by_text = {texts[i]: row[7] for i, row in got}
    assert by_text[QUALITY_ODD[10]] is None
    assert all(by_text[t] is not None for t in JUNK.values())
    assert quality.quality_verdicts(documents(spark, [])).count() == 0


def test_each_rule_rejects_its_kind_and_order_changes_nothing():
    texts = [t or "" for t in QUALITY_ODD]
    whole = quality.Texts(*spans.text_bytes(pa.array(texts)))
    alone = {r.name: r.rejects(whole) for r in quality.RULES}
    for name, text in JUNK.items():
        assert alone[name][texts.index(text)], name
        assert not alone[name][10]
    want = np.any(list(alone.values()), axis=0)
    for rules in (quality.RULES, quality.RULES[::-1]):
        fresh = quality.Texts(*spans.text_bytes(pa.array(texts)))
        by = quality.cascade(fresh, rules)
        assert ((by >= 0) == want).all()
        assert all(alone[rules[b].name][i] for i, b in enumerate(by) if b >= 0)


def test_order_is_by_rejection_per_cost():
    # Rule 0 rejects most but is dear, rule 1 adds nothing to rule 2, rule 2 is cheap.
    masks = {0b000: 50, 0b001: 30, 0b110: 10, 0b100: 10}
    assert quality.best_order(masks, [10.0, 0.4, 1.0]) == [1, 2, 0]
    assert quality.best_order(masks, [10.0, 2.0, 1.0]) == [2, 0, 1]
    assert quality.best_order(masks, [1.0, 2.0, 1.0]) == [0, 2, 1]
    assert quality.best_order({}, [2.0, 1.0]) == [1, 0]


def test_plan_samples_few_rows(spark):
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(QUALITY_ODD * 40)]).repartition(3)
    planned = quality.plan_cascade(docs)
    assert sorted(r.name for r in planned) == sorted(r.name for r in quality.RULES)
    assert len(quality.plan_cascade(docs.limit(0))) == len(quality.RULES)
