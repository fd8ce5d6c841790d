"""Inputs on which corpus operators once gave wrong answers."""

from __future__ import annotations

import os
import time

import numpy as np
import pyarrow as pa
import pytest

from codeshoal.llm import common, langid, linededup, neighbours, pieces, toxicity, wrapper


def test_words_are_letters_with_their_marks():
    assert list(langid.words_of("½ ² x² É2té Ét́ ́a नमस्ते 𝐀b Ⅷ")) == [
        "x", "é", "té", "ét́", "a", "नमस्ते", "𝐀b"]


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, f"eins zwei drei {i}", "de") for i in range(40)] + [
        (100, "½", "de"), (101, "² 3 Ⅷ", None), (102, "́", None), (103, "zwei", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs).collect()}
    assert [got[i] for i in (100, 101, 102, 103)] == [langid.UNKNOWN] * 3 + ["de"]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_texts_that_hold_marks_come_back(spark):
    texts = ["a\n\0\0mark", "▁", "▁▁ a▁▁b", "a\n▁▁mark\t\0\0mark ▁\0\0mark", "\0\0mark", " ", "x  y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert all(r.text == r.decoded for r in back.collect())


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_columns_of_the_same_name_give_way(spark):
    docs = spark.createDataFrame(
        [(1, "one two", "old", 0.5, "xx", [1])],
        "doc_id long, text string, IDS string, score double, Lang_pred string, decoded array<int>")
    encoded = pieces.encode_pieces(docs)
    assert encoded.columns == ["doc_id", "text", "score", "Lang_pred", "decoded", "ids"]
    assert pieces.decode_pieces(encoded).first().decoded == "one two"
    model = langid.Model(["de", "en"], {"one": [0, 30], "ein": [30, 0]}, {}, (1,))
    assert langid.identify(docs, model).first().lang_pred == "en"
    rated = toxicity.rate(docs, toxicity.fit([], np.zeros(0), np.zeros(0, np.int64), np.zeros(0)))
    assert 0 < rated.first().score < 1 and rated.columns.count("score") == 1


def test_batches_are_sliced_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 100)
    texts = ["a" * 30, None, "", "b" * 500, "c", "d" * 10]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(6))})
    parts = list(common.sliced([batch], "text"))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(6))
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 or len(p) == 1
               for p in parts)
    lists = pa.RecordBatch.from_pydict({"ids": [[1] * 40, None, [], [2] * 3]})
    assert sum(len(p) for p in common.sliced([lists], "ids")) == 4


def neighbours_brute(rows, k=5):
    """By whole-number arithmetic on scaled vectors, so that nothing overflows."""
    rows = [(i, np.array(v, np.longdouble)) for i, v in rows]
    found = []
    for a, (i, v) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted(
            (-float((v * w).sum() / np.sqrt((v * v).sum()) / np.sqrt((w * w).sum())), j)
            for b, (j, w) in enumerate(rows) if a != b and len(w) == len(v))
        found += [(i, r + 1, -s) for r, (s, _) in enumerate(scored[:k])]
    return sorted(found)


def test_extreme_repeated_and_mixed_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(50, (base[0] * 1e200).tolist()), (51, (base[1] * 1e-200).tolist()),
             (100, (base[2] * 1e-300).tolist()), (0, (-base[0]).tolist()), (0, base[3].tolist()),
             (200, [1.0, 2.0]), (201, [1.0, 2.5]), (202, [1e300, 1e300]), (250, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = neighbours.nearest(table, "vec_id % 50 = 0").collect()
    want = neighbours_brute(rows)
    assert [(r.query_id, r.rank) for r in sorted(got, key=lambda r: (r.query_id, r.rank, r.score))
            ] == [(i, r) for i, r, _ in want]
    assert np.allclose(sorted(r.score for r in got), sorted(s for _, _, s in want))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, 0.0] if i % 2 else [0.0, 1.0, 0.0]) for i in range(300)]
    got = neighbours.nearest(spark.createDataFrame(
        rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    for q in range(0, 300, 50):
        found = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        same = [i for i in range(0, 300, 2) if i != q][:5]
        assert [x[1] for x in found] == same and all(x[2] == pytest.approx(1.0) for x in found)


def test_pages_of_unclosed_tags_are_read_in_linear_time():
    for part in ("<font>", "<a '", "<a b", "<!", "<font></x>", "<li><b>", "<a \"x\" '"):
        start = time.perf_counter()
        root = wrapper.parse(part * 100_000)
        assert time.perf_counter() - start < 30 and root.count > 1, part
    assert wrapper.main_text("<font>" * 100_000 + "<hr>" * 100_000 + "<p>end</p>").endswith("end")


def test_tags_end_outside_quotes():
    assert wrapper.main_text("<p title='a>b'>one</p><p x=\"'>\">two") == "one\ntwo"
    assert wrapper.main_text("<p>a <b 'c</p>") == "a <b 'c"
    assert wrapper.main_text("<p>1 < 2 <3</p><!-- <p>no</p> --><p>four") == "1 < 2 <3\nfour"
    assert wrapper.main_text("<ul><li>a<li><b>c<ul><li>d</ul>e</b><li>f</ul>") == "a\nc\nd\ne\nf"


def test_line_dedup_of_a_text_of_many_lines(spark):
    lines = [f"{i} {i * 7919 % 100_003} {i * i % 99_991} line" for i in range(20_000)]
    docs = spark.createDataFrame(
        [(1, "\n".join(lines + ["", *lines])), (2, "one\n" + lines[5] + "\n"), (3, None)],
        "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs, 1.0).collect()}
    assert got == {1: "\n".join(lines + [""]), 2: "one\n", 3: None}
