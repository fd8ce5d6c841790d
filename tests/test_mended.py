"""Small wrong answers of earlier versions."""

from __future__ import annotations

import json

from codeshoal.operators import upserts as U
from codeshoal.sources import corpora


def test_a_list_of_one_object_of_arrays_stays_a_row(spark, tmp_path):
    listed, columns = tmp_path / "list.json", tmp_path / "dict.json"
    listed.write_text(json.dumps([{"a": [1, 2], "b": [3, 4]}]))
    columns.write_text(json.dumps({"a": [1, 2], "b": [3, 4]}))
    assert [tuple(r) for r in corpora.read_json(spark, str(listed)).collect()] == [([1, 2], [3, 4])]
    assert sorted(map(tuple, corpora.read_json(spark, str(columns)).collect())) == [(1, 3), (2, 4)]


def test_upsert_without_sequence_keeps_the_same_row(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    rows = [(1, f"new{i}") for i in range(20)]
    kept = {U.upsert(old, spark.createDataFrame(part, "id int, v string").repartition(n), ["id"])
            .where("id = 1").first().v for n, part in ((1, rows), (5, rows[::-1]), (3, rows))}
    assert len(kept) == 1 and kept != {"old"}
