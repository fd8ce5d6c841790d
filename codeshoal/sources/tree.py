"""A folder of files as a Spark data source: batch, stream and write."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter,
    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from .. import catalogs as C
from ..operators.findings import glob_regex

FORMAT = "source_tree"
LISTING = "path string, size_bytes bigint, modified bigint"
# A split ends after so many bytes or files; opening a file counts as so many bytes.
SPLIT_BYTES, SPLIT_FILES, OPEN_BYTES = 32 << 20, 10_000, 64 << 10
# Bytes of content in one Arrow batch; a larger file is a batch by itself.
BATCH_BYTES = 8 << 20
LISTERS = 16
# Hidden parts and dependency or cache folders anywhere in the path.
SKIPPED = rf"(?:^|/)(?:\.[^/]*|{'|'.join(C.SKIPPED_DIRECTORIES)})(?:/|$)"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it take filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SourceTree)


def base_uri(root: str) -> str:
    return root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)


@dataclass
class Split(InputPartition):
    """Files that one task reads: (path, bytes, modified in microseconds)."""

    files: list[tuple[str, int, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class Tree:
    """What a read of a tree needs; a plain object that travels to tasks."""

    def __init__(self, options: dict):
        self.base = base_uri(options["path"])
        patterns = json.loads(options.get("include", "[]"))
        self.include = "|".join(glob_regex(p) for p in patterns)
        self.skip = options.get("skiprules", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, Callable, object]] = []

    def taken(self, path: str, size: int, modified: int) -> bool:
        row = {"path": path, "size_bytes": size, "modified": modified}
        return (not self.include or re.search(self.include, path) is not None) and all(
            test(row[name], value) for name, test, value in self.tests)

    def listed(self) -> list[tuple[str, int, int]]:
        """Files in the order of their paths; folders that rules skip are never opened."""
        fs, top = pafs.FileSystem.from_uri(self.base)
        strip = len(top.rstrip("/")) + 1
        found, folders = [], [top]
        with ThreadPoolExecutor(LISTERS) as pool:
            while folders:
                entries = pool.map(lambda d: fs.get_file_info(pafs.FileSelector(d)), folders)
                folders = []
                for info in (i for part in entries for i in part):
                    rel = info.path[strip:]
                    if self.skip and re.search(SKIPPED, rel):
                        continue
                    if info.type == pafs.FileType.Directory:
                        folders.append(info.path)
                    else:
                        row = rel, info.size or 0, (info.mtime_ns or 0) // 1000
                        if self.taken(*row):
                            found.append(row)
        return sorted(found)

    def splits(self, files: list[tuple[str, int, int]]) -> list[Split]:
        """Neighbouring files together, about ``split_bytes`` each."""
        found: list[Split] = []
        size = 0
        for file in files:
            weight = file[1] + OPEN_BYTES if self.content else OPEN_BYTES // 64
            if not found or size + weight > self.split_bytes or len(
                    found[-1].files) >= SPLIT_FILES:
                found.append(Split([]))
                size = 0
            found[-1].files.append(file)
            size += weight
        return found

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """Arrow batches of a split's files; what cannot be read becomes an error row."""
        fs, top = pafs.FileSystem.from_uri(self.base)
        rows: list[tuple] = []
        size = 0
        for path, length, modified in split.files:
            if not self.content:
                rows.append((path, length, modified))
                continue
            if rows and size + length > BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
            try:
                with fs.open_input_stream(f"{top.rstrip('/')}/{path}") as stream:
                    content, error = stream.read(), None
            except OSError as problem:
                content, error = None, str(problem)
            rows.append((path, length, modified, content, error))
            size += length
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "size_bytes": pa.int64(), "modified": pa.int64()}
        if self.content:
            kinds |= {"content": pa.binary(), "error": pa.string()}
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    IsNotNull: lambda x, v: True,
}


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on path, size and time choose files before any is opened."""
        for test in filters:
            name = test.attribute[0]
            if type(test) in TESTS and name in ("path", "size_bytes", "modified"):
                self.tree.tests.append((name, TESTS[type(test)], getattr(test, "value", None)))
            else:
                yield test

    def partitions(self) -> list[Split]:
        return self.tree.splits(self.tree.listed()) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeStream(DataSourceStreamReader):
    """Files in the order of their modification times; a batch takes those since the last."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        return {"modified": max((m for _, _, m in self.tree.listed()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        new = [f for f in self.tree.listed() if start["modified"] < f[2] <= end["modified"]]
        return self.tree.splits(new) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to forget: files stay where they are."""


class TreeWriter(DataSourceArrowWriter):
    """Each row's ``content`` (text or bytes) as a file at its ``path``; a retry writes it again."""

    def __init__(self, base: str):
        self.base = base

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = pafs.FileSystem.from_uri(self.base)
        made: set[str] = set()
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content")):
                path, content = path.as_py(), content.as_py()
                if path is None or content is None:
                    continue
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path below the folder: {path}")
                folder = f"{top.rstrip('/')}/{path}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{top.rstrip('/')}/{path}") as stream:
                    stream.write(content.encode() if isinstance(content, str) else content)
        return WriterCommitMessage()


class SourceTree(DataSource):
    """Files below a folder, one row each: path, size, time, bytes, error.

    Options: ``path``; ``include`` (JSON list of globs); ``skipRules`` (leave out hidden parts and
    dependency folders); ``splitBytes``; ``content`` (false: listing only).  Spark's own file
    listing leaves out names that start with '_' or '.', so it would lose files like
    __init__.py.  As there, paths, sizes and times are listed when the read is planned, folder by
    folder in threads; contents are only read by tasks, split by bytes.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING + (", content binary, error string" if Tree(self.options).content else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(Tree(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Tree(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(base_uri(self.options["path"]))
