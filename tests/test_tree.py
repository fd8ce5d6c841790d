"""The folder data source on real files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from codeshoal.sources import files as SRC
from codeshoal.sources import tree


@pytest.fixture
def folder(tmp_path):
    texts = {f"pkg/m{i:03d}.py": f"x = {i}\n" * 50 for i in range(120)} | {
        "pkg/__init__.py": "", "pkg/.hidden/a.py": "h", "node_modules/lib/a.js": "n",
        "top.js": "let a;", "data.bin": "\0\1", "deep/a/b/c/d.txt": "t", "_under.py": "u"}
    for path, text in texts.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "bad.py").write_bytes(b"ok \xff\xfe end")
    return tmp_path, texts


def test_rules_choose_files(spark, folder):
    root, texts = folder
    got = {r.path: r for r in SRC.read_tree(spark, str(root), "r").collect()}
    hidden = {"pkg/.hidden/a.py", "node_modules/lib/a.js"}
    assert set(got) == set(texts) - hidden | {"bad.py"}
    assert got["pkg/m007.py"].content == texts["pkg/m007.py"] and got["pkg/__init__.py"].content == ""
    assert got["bad.py"].content == "ok  end" and got["data.bin"].error == "binary file"
    everything = SRC.read_tree(spark, str(root), "r", skip_rules=False)
    assert everything.count() == len(texts) + 1
    some = SRC.read_tree(spark, str(root), "r", ["*.js", "m00?.py"])
    assert {r.path for r in some.collect()} == {"top.js"} | {f"pkg/m00{i}.py" for i in range(10)}


def test_a_folder_is_many_tasks(spark, folder):
    root, _ = folder
    one = SRC.read_tree(spark, str(root), "r")
    many = SRC.read_tree(spark, str(root), "r", split_bytes=tree.OPEN_BYTES * 10)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 14
    assert one.exceptAll(many).count() == 0 and many.count() == one.count()


def test_filters_are_pushed_to_the_listing(spark, folder):
    root, texts = folder
    files = SRC.read_tree(spark, str(root), "r")
    chosen = files.where(F.col("path").startswith("pkg/m01") & (F.col("size_bytes") > 10))
    assert {r.path for r in chosen.select("path").collect()} == {f"pkg/m01{i}.py" for i in range(10)}
    reader = tree.TreeReader(tree.Tree({"path": str(root)}))
    tests = [tree.StringStartsWith(("path",), "pkg/m01"), tree.GreaterThan(("size_bytes",), 10),
             tree.EqualTo(("content",), b"x")]
    assert list(reader.pushFilters(tests)) == tests[2:]
    assert sum(len(s.files) for s in reader.partitions()) == 10
    assert files.where("path IN ('top.js', 'none')").count() == 1


def test_listing_opens_nothing(spark, folder):
    root, texts = folder
    listed = SRC.list_tree(spark, str(root), include_patterns=["*.py"])
    assert listed.columns == ["path", "size_bytes", "modified"]
    sizes = {r.path: r.size_bytes for r in listed.collect()}
    assert sizes["pkg/m001.py"] == len(texts["pkg/m001.py"]) and "top.js" not in sizes


def test_files_that_cannot_be_read_are_rows(spark, folder):
    root, _ = folder
    reader = tree.Tree({"path": str(root)})
    batch = next(reader.read(tree.Split([("gone.py", 3, 0), ("top.js", 6, 0)])))
    rows = batch.to_pylist()
    assert rows[0]["content"] is None and "gone.py" in rows[0]["error"]
    assert rows[1]["content"] == b"let a;" and rows[1]["error"] is None


def test_empty_folder(spark, tmp_path):
    assert SRC.read_tree(spark, str(tmp_path), "r").count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a/b.py", "x = 1"), ("a/c d.txt", "ü"), (None, "no path"), ("e.js", None)],
        "path string, content string")
    SRC.write_tree(rows, str(tmp_path / "out"))
    SRC.write_tree(rows, str(tmp_path / "out"))
    back = SRC.read_tree(spark, str(tmp_path / "out"), "r")
    assert {(r.path, r.content) for r in back.collect()} == {("a/b.py", "x = 1"), ("a/c d.txt", "ü")}
    with pytest.raises(Exception, match="not a path below the folder"):
        SRC.write_tree(spark.createDataFrame([("../x", "y")], "path string, content string"),
                       str(tmp_path / "out"))


def test_stream_takes_new_and_changed_files(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    root.mkdir()

    def put(name, text, seconds):
        (root / name).write_text(text)
        os.utime(root / name, (seconds, seconds))

    def run():
        query = SRC.read_tree_stream(spark, str(root), "r", ["*.py"]).select(
            "path", "content").writeStream.format("parquet").option(
            "checkpointLocation", state).trigger(once=True).start(out)
        query.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    put("a.py", "one", 1000)
    put("skip.js", "no", 1000)
    assert run() == [("a.py", "one")]
    put("b.py", "two", 2000)
    put("a.py", "changed", 3000)
    assert run() == [("a.py", "changed"), ("a.py", "one"), ("b.py", "two")]
    assert len(run()) == 3
