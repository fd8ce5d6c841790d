"""Corpus operators next to brute force, round trips and hand-made rows."""

from __future__ import annotations

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from codeshoal.llm import (
    chat, components, digest, langid, linededup, mixing, neighbours, pieces, simhash, toxicity,
    wrapper)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, Size int"
LONG = "alpha beta gamma delta " * 20_000


def documents(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame(
        [(i, t, lang, s, len(t or ""), 7, 8) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [
        (1, "the cat sat on the mat\nand so on", "en", "a"), (2, None, None, None),
        (3, "", "en", "a"), (3, "", "en", "a"), (None, "no id here", "de", "b"),
        (5, LONG, "en", ""), (6, LONG + "omega", None, "b"), (7, " \t\n ", "fr", None),
        (8, "The cat sat on the mat\nand so on", "en", "c"),
    ])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [
        (0, i) for i in range(1000, 1400)]
    got = dict(map(tuple, components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()))
    want = classes({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(
        spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_masks_meet_every_close_pair():
    masks = simhash.block_masks(6, 3)
    rng = np.random.default_rng(2)
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in masks)


def test_simhash_classes(spark, odd, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(0, 10 ** 6)}" for _ in range(400)]
    rows = [(100 + i, " ".join(base[:i % 40] + [f"x{i}"] + base[i % 40 + 1:]), "en", "a")
            for i in range(60)]
    docs = documents(spark, rows).unionByName(odd)
    monkeypatch.setattr(simhash, "PIECE", 8)
    got = sorted(map(tuple, simhash.simhash_classes(docs).collect()), key=str)
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [simhash.fingerprint(t) for _, t in items]
    links = [(i, j) for i in range(len(items)) for j in range(i)
             if bin(prints[i] ^ prints[j]).count("1") <= 3]
    of = classes(range(len(items)), links)
    members = defaultdict(list)
    for i, c in of.items():
        members[c].append(items[i][0])
    want = [(items[i][0], f"{prints[i]:016x}", min(
        (x for x in members[of[i]] if x is not None), default=None)) for i in range(len(items))]
    assert got == sorted(want, key=str)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert simhash.simhash_classes(empty(spark)).count() == 0
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_mix_reaches_targets(spark, odd):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", f"s{min(i % 9, 4)}") for i in range(3000)]
    docs = documents(spark, rows).unionByName(odd.where("doc_id <> 5 AND doc_id <> 6"))
    plan = mixing.mix_plan(docs).toPandas()
    sums = plan.groupby("source", dropna=False).agg(
        size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert sums.target.sum() == pytest.approx(plan["size"].sum())
    assert (sums.target <= 3 * sums["size"] + 1e-6).all()
    assert (plan.taken <= 3 * plan["size"]).all()
    assert ((sums.taken - sums.target).abs() <= 61).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.copies.sum()
    assert mixing.mix_plan(docs).toPandas().sort_values(["doc_id", "size"]).taken.tolist() == \
        plan.sort_values(["doc_id", "size"]).taken.tolist()
    assert mixing.mix_plan(empty(spark)).count() == 0


def test_targets_match_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "e": 400}
    got = {r["key"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(
        list(sizes.items()), "key string, source_size long")).collect()}
    weight = dict(zip(sorted(sizes), (1, 2, 3, 1, 2)))
    full: dict = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        open_ = [k for k in sizes if k not in full]
        share = {k: left * weight[k] / sum(weight[o] for o in open_) for k in open_}
        over = {k: 3.0 * sizes[k] for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            break
        full.update(over)
    want = full | share
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_digest_of_edited_documents(spark, odd):
    got = digest.edit_likeness(odd, parts=3).collect()
    items = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()),
                   key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (doc_id, text), (_, after) in zip(items, items[1:] + items[:1]):
        changed = digest.edited(text, after)
        own, other = digest.fingerprint(text.encode()), digest.fingerprint(changed.encode())
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other,
                     digest.likeness(own, other),
                     digest.likeness(own, digest.fingerprint(after.encode()))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert digest.edit_likeness(empty(spark)).count() == 0
    assert digest.edit_likeness(odd.where("doc_id = 1")).count() == 1


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 24)) + 3 * rng.standard_normal((10, 24))[
        rng.integers(0, 10, 3000)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [
        (5000, None, 1), (5050, [0.0] * 24, 1), (5100, [float("nan")] * 24, 1),
        (5150, [None] + [1.0] * 23, 1), (5200, [1.0], 1), (None, [1.0] * 24, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(table, "vec_id % 50 = 0").toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        found = got[got.query_id == q].sort_values("rank")
        assert found["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(found.score, cosine[found.vec_id])
        hits += len(set(found.vec_id) & set(np.argsort(-cosine)[:5]))
    assert hits >= 0.9 * 5 * 60 and got.query_id.max() < 3000
    assert neighbours.nearest(table.where("vec_id >= 5000"), "vec_id % 50 = 0").count() == 0


def test_language_id(spark, odd):
    words = {"en": "the of and thing with", "de": "der und nicht eine mit",
             "fr": "le et une dans avec"}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[k].split(), 8)), k, "s")
            for i in range(200) for k in [("en", "de", "fr")[i % 3]]]
    got = langid.predict_languages(documents(spark, rows)).toPandas()
    want = {r[0]: r[2] for r in rows}
    assert (got.lang_pred == got.doc_id.map(want)).all() and got.held_out.sum() > 10
    plain = langid.predict_languages(odd).toPandas()
    assert len(plain) == 9
    assert (plain[plain.doc_id.isin([2, 3, 7])].lang_pred == langid.UNKNOWN).all()
    assert langid.predict_languages(empty(spark)).count() == 0


def similar_pairs(lines):
    sets = {x: linededup.shingles(x) for x in lines}
    return [(a, b) for a in lines for b in lines
            if a < b and linededup.similar(sets[a], sets[b], 0.8)]


def test_line_dedup(spark, odd, monkeypatch):
    monkeypatch.setattr(linededup, "PIECE", 4)
    rng = np.random.default_rng(7)
    base = [f"word{rng.integers(0, 10 ** 6)}" for _ in range(60)]
    lines = [" ".join(base[:i] + [f"v{i}"] + base[i + 1:]) for i in range(20)]
    rows = [(100 + i, f"{line}\n\nown line {i * 7919}\n Shared by all ", "en", "a")
            for i, line in enumerate(lines)]
    docs = documents(spark, rows).unionByName(odd)
    got = {(r["doc_id"], r["n_chars"], r["text"]) for r in linededup.dedup_lines(docs).collect()}
    items = sorted({(r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5(
        (r["text"] or "").encode()).digest(), r["text"]) for r in docs.collect()},
        key=lambda x: x[:3])
    distinct = sorted({s for x in items for line in (x[3] or "").split("\n")
                       if (s := line.strip())})
    of, seen, want = classes(distinct, similar_pairs(distinct)), set(), set()
    for missing, doc_id, _, text in items:
        out = []
        for line in (text or "").split("\n"):
            mark = of.get(line.strip())
            if mark is None or mark not in seen:
                out.append(line)
            if mark is not None:
                seen.add(mark)
        new = None if text is None else "\n".join(out)
        want.add((None if missing else doc_id, len(new or ""), new))
    assert got == want
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert linededup.dedup_lines(empty(spark)).count() == 0


def brute_score(word, vocabulary):
    best = [0.0] + [float("-inf")] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = best[j - 1] + vocabulary.byte_score
        for i in range(j):
            hit = vocabulary.endings.get(word[i:j])
            if hit and hit[1] >= 0:
                best[j] = max(best[j], best[i] + hit[0])
    return best[-1]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_pieces_round_trip_and_best_score(spark, odd):
    vocabulary = pieces.Vocabulary.load()
    words = sorted({pieces.MARK + w for w in "the there thereby theory ünïcode 日本 x".split()})
    for word, ids in zip(words, pieces.segment_words(words, vocabulary)):
        if all(i not in vocabulary.bytes.values() for i in ids):
            total = sum(vocabulary.endings[vocabulary.pieces[i]][0] for i in ids)
            assert total == pytest.approx(brute_score(word, vocabulary))
    texts = ["", " ", "  two  spaces ", "a▁b▁", "tab\tnew\nline\r\n", "\0\0mark", "日本語 emoji 😀", LONG]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).unionByName(odd)
    encoded = pieces.encode_pieces(docs)
    assert [r["text"] for r in pieces.decode_pieces(encoded).select("text", "decoded").where(
        "NOT text <=> decoded").collect()] == []
    rows = pieces.round_trip(docs).collect()
    assert len(rows) == len(texts) + 9
    want = sorted(str(hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted(r["decoded_sha256"] for r in rows[:len(texts)]) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/x">Menu %d</a></ul></nav><div class="cookie-notice">We use cookies</div>
<header><h2>Site</h2></header><!-- hidden --><div class="ad">Buy %d</div>
<article><h1>Title %d</h1><p>First&nbsp;para &amp; <b>bold %d</b> end<br><p>Second
  para %d<p class=note>Written by the desk</p><form><input><p>Sign up</p></form>
<div id="comments"><p>Nice</p></div></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_html_extraction(spark):
    rows = [(i, "http://h.example/%d" % i, PAGE % (i, i, i, i, i), 1) for i in range(12)]
    rows += [(50, None, None, 1), (51, "bad", "", 1), (52, "http://o.example/", "plain <p>text", 1),
             (53, "http://o.example/a", "<div><p>" + "<span>" * 3000 + "deep", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(table).collect()}
    assert got[3] == "Title 3\nFirst para & bold 3 end\nSecond para 3"
    assert got[50] == got[51] == "" and got[52] == "plain\ntext" and got[53] == "deep"
    few = {r["page_id"]: r["text"] for r in wrapper.extract(table.where("page_id < 3")).collect()}
    assert few[1] == "Title 1\nFirst para & bold 1 end\nSecond para 1\nWritten by the desk"
    assert wrapper.extract(table.where("page_id < 0")).count() == 0


def test_tree_matching_pairs_common_nodes():
    left = wrapper.parse("<ul><li>a<li><b>x</b><li>c</ul>")
    right = wrapper.parse("<ul><li>a<li>c<li><i>y</i></ul>")
    pairs = wrapper.align(left, right)
    # The root, the list, its first item with its text, and two more nodes at best.
    assert len(pairs) == 6
    assert all(a.tag == b.tag for a, b in pairs)


def test_template_language():
    render = chat.compile_template(
        "{% for m in messages %}{% if loop.first and not false %}<{{ 'a' + 'b' | upper }}>"
        "{% elif m.role in 'xy' %}-{% else %}+{% endif %}{{ m['text'] | trim }}{% endfor %}")
    assert render([{"role": "x", "text": " 1 "}, {"role": "x", "text": "2"},
                   {"role": "q", "text": "3"}])[0] == "<aB>1-2+3"
    assert chat.fold(chat.parse("a{{ 1 }}{% if 1 == 2 %}b{% else %}c{% endif %}")) == (
        "block", ("text", "a1c"))
    for bad in ("{% for x %}", "{{ a.__class__ }}", "{{ a | open }}", "{% if a %}", "{{ ( }}",
                "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.compile_template("{{ messages.append }}")([])[0] == ""


def test_chats_are_read_back(spark):
    rows = [(1, 0, "user", "a</s>\\<|im_end|>"), (1, 1, "assistant", "[INST]<|im_start|>\\\\"),
            (1, 1, "assistant", "x"), (2, None, None, None), (2, 0, "tool<|im_sep|>", ""),
            (None, 3, "assistant", LONG)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(table)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    first = [rows[0], rows[1], rows[2]]
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in first))
    assert got[1]["loss_sha256"] == sha(rows[1][3] + "x")
    assert got[1]["loss_chars"] == len(rows[1][3]) + 1
    assert got[2]["turns_sha256"] == sha("tool<|im_sep|>\n\n\n\n") and got[2]["n_turns"] == 2
    assert got[None]["loss_chars"] == len(LONG)
    assert chat.format_chats(table.where("conv_id > 9")).count() == 0


def test_toxicity(spark, odd):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(rng.choice(plain, 30)) + (" vile scum " if bad else " kind soul ")
        rows.append((1000 + i, text, "en", "a"))
        labels.append((1000 + i, 0, int(bad)))
    labels += [(None, 0, 1), (1001, 0, 1), (3, 0, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).unionByName(odd)
    got = toxicity.toxicity_scores(docs, marks).toPandas()
    own = got[got.doc_id >= 1000]
    assert ((own.predicted == 1) == (own.doc_id % 4 == 0)).all()
    assert got.score.between(0, 1).all() and len(got) == 409
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000").count() == 300
    assert toxicity.toxicity_scores(empty(spark), marks).count() == 0
    assert toxicity.toxicity_scores(odd, marks.where("false")).count() == 9


def test_line_links_connect_what_brute_force_connects():
    rng = random.Random(7)
    for count in (1, 2, 9, linededup.FEW, linededup.FEW + 1, 60):
        for length in (4, 12, 70):
            base = [rng.choice("abc ") for _ in range(length)]
            texts = set()
            for _ in range(count):
                line = list(base)
                for _ in range(rng.randint(0, 2)):
                    line[rng.randrange(length)] = rng.choice("xyz")
                texts.add("".join(line))
            items = [(b"%04d" % i, line) for i, line in enumerate(sorted(texts))]
            sets = [linededup.shingles(line) for _, line in items]
            expected = list(range(len(items)))
            for i in range(len(items)):
                for j in range(i):
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        low, high = sorted((expected[i], expected[j]))
                        expected = [low if c == high else c for c in expected]
            found = linededup.line_links(items, 0.8)
            assert sorted(found) == sorted(
                (items[c][0], items[i][0]) for i, c in enumerate(expected) if c != i)


def test_anchors_and_class_words_of_an_article_are_no_asides():
    page = """<body><div class="has-sidebar"><article><h1>A</h1>
<section id="discussion"><h2 id="side-effects">B</h2><p class="share-price">C</p></section>
<section id="related-work"><p id="cookies">D</p></section><div class="section" id="comments">E</div>
<div class="cookie-cutter">F</div><p class="banner-year">G</p><h2 id="ad">H</h2>
<div class="card ad">no</div><div id="newsletter">no</div><ul class="comments"><li>no</ul></article>
</div></body>"""
    assert wrapper.main_text(page) == "\n".join("ABCDEFGH")
    page = """<body><div class="sidebar">no</div><div id="footer">no</div><h1 id="menu">A</h1>
<p id="navigation">B</p><div id="discussion">C</div></body>"""
    assert wrapper.main_text(page) == "A\nB\nC"


COPIED = ("<body><article><h1>%s</h1><p>%s</p><p>%s</p><p>seen %d times</p>"
          "<p>Written by the desk of this paper</p></article></body>")


def test_copies_of_an_article_do_not_make_it_a_template(spark):
    def words(i):
        return [f"{name} of article {i} " + f"{name}{i} " * 30 for name in ("title", "one", "two")]

    pages = [COPIED % (*words(0), i) for i in range(200)]
    few = pages + [COPIED % (*words(i), i) for i in (1, 2)]
    many = pages + [COPIED % (*words(i), i) for i in range(1, 15)]
    rows = [(i, f"http://few/{i}", p) for i, p in enumerate(few)] + [
        (1000 + i, f"http://many/{i}", p) for i, p in enumerate(many)]
    got = {r["page_id"]: r["text"].split("\n") for r in wrapper.extract(spark.createDataFrame(
        rows, "page_id long, url string, html string")).collect()}
    for i in (0, 7, 199):
        article = [t.strip() for t in words(0)] + [f"seen {i} times"]
        assert got[i] == article + ["Written by the desk of this paper"]
        assert got[1000 + i] == article
    assert got[1201] == [t.strip() for t in words(2)] + ["seen 2 times"]


def test_deep_and_wide_pages_are_aligned(spark):
    def deep(n, word):
        return "<body><article>" + "<span><b>x</b>" * n + f"{word}</article>"

    def wide(shift):
        return "<body><article>" + "".join(
            f"<div>{'<i>z</i>' * ((i * 7 + shift) % 61)}<b>{'<u>t</u>' * ((i + shift) % 97)}</b></div>"
            for i in range(3000)) + f"end {shift}</article>"

    rows = [(1, "http://d/1", deep(3000, "one")), (2, "http://d/2", deep(2500, "two")),
            (3, "http://w/1", wide(0)), (4, "http://w/2", wide(5))]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(
        rows, "page_id long, url string, html string")).collect()}
    assert got[1].endswith("one") and got[2].endswith("two")
    assert got[3].endswith("end 0") and got[4].endswith("end 5")


def test_split_lists_pair_what_is_equal(monkeypatch):
    rng = random.Random(7)
    items = [f"<li>{'<b></b>' * rng.randrange(30)}<i>{'<u></u>' * rng.randrange(30)}</i></li>"
             for _ in range(120)]
    left = wrapper.parse("<ol>" + "".join(items) + "</ol>")
    right = wrapper.parse("<ol>" + "".join(items[5:60] + items[:4] + items[66:]) + "</ol>")
    whole = wrapper.align(left, right)
    monkeypatch.setattr(wrapper, "CELLS", 64)
    split = wrapper.align(left, right)
    assert all(a.tag == b.tag for a, b in split)
    assert len(whole) >= len(split) >= 0.95 * len(whole)
    assert len({a.number for a, _ in split}) == len({b.number for _, b in split}) == len(split)


@pytest.mark.parametrize("turns", [0, 1, 6])
def test_long_lists_are_matched_as_well_as_short_ones(monkeypatch, turns):
    rng = random.Random(5)
    inner = ["<b>x</b>", "<i>y</i>", "z", "<u><b>x</b></u>", "<u>w<i>y</i></u>"]
    items = ["<p>x</p>", "<h2>y</h2>", "<br>"]

    def page(n):
        return wrapper.parse("<body>" + "".join(
            rng.choice(items) if rng.random() < 0.5 else
            "<div>" + "".join(rng.choices(inner, k=rng.randrange(9))) + "</div>"
            for _ in range(n)) + "</body>")

    for n in (5, 40, 70):
        left, right = page(n), page(n - 3)
        whole = wrapper.align(left, right)
        with monkeypatch.context() as m:
            m.setattr(wrapper, "CELLS", 12)
            m.setattr(wrapper, "TURNS", turns)
            m.setattr(wrapper, "MOST_SIZES", 3)
            m.setattr(wrapper, "MOST_ROWS", 2)
            m.setattr(wrapper, "ROW_CELLS", 1)
            long = wrapper.align(left, right)
        assert len(long) == len(whole)
        assert all(a.tag == b.tag for a, b in long)
        assert len({a.number for a, _ in long}) == len({b.number for _, b in long}) == len(long)


def test_other_ngrams_leave_a_long_text_its_score(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 50)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 20))
             + (" vile scum" if i % 4 == 0 else " kind soul"), "en", "a") for i in range(200)]
    greek = [chr(c) for c in range(0x3B1, 0x3C9)]
    long = "".join(rng.choice(greek, 300_000))
    rows += [(901, long, "el", "a"), (902, "\u03b1", "el", "a"), (903, long + " vile scum ", "el", "a"),
             (904, " vile scum ", "el", "a")]
    marks = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(
        documents(spark, rows), marks).collect()}
    assert got[901] == got[902] < got[903] == got[904]


def test_long_texts_give_their_ngrams_in_parts(monkeypatch):
    text = "some words, some more words, and some more"
    (whole,) = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE", 5)
    parts = list(toxicity.features(text))
    assert len(parts) == 9 and sorted(np.concatenate(parts)) == whole.tolist()


def test_few_candidates_are_all_neighbours(spark):
    # Along its longest axis the projection stretches a vector most.
    axis = np.linalg.svd(neighbours._projection(24, neighbours.DIMENSIONS))[0][:, 0]
    table = spark.createDataFrame(
        [(0, axis.tolist()), (1, (-axis).tolist()), (2, (-2 * axis).tolist())],
        "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, "vec_id = 0").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2)]


def test_turns_without_a_conversation_stay_apart(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"),
            (None, None, None, None), (7, 0, "user", "c"), (7, 1, "assistant", "d")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(table).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in got) == [(0, 1)] * 4 + [(7, 2)]
    assert sorted(chat.read_back(r["formatted"])[0] for r in got if r["conv_id"] is None) == [
        ("", ""), ("assistant", "b"), ("user", "a"), ("user", "a")]
