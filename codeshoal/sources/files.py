"""Reading source trees as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions.languages import detect_language
from ..operators.findings import glob_regex
from . import tree


def included(path: Column, patterns: Sequence[str] | None) -> Column:
    """Whether a path matches any include pattern (all, when there are none)."""
    if not patterns:
        return F.lit(True)
    return F.rlike(path, F.lit("|".join(glob_regex(p) for p in patterns)))


def skipped(path: Column) -> Column:
    """Hidden parts and dependency or cache folders anywhere in the path."""
    return F.rlike(path, F.lit(tree.SKIPPED))


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 1024 bytes; unreadable content counts as binary."""
    return F.coalesce(
        F.contains(F.substring(content, 1, 1024), F.lit(b"\x00")), F.lit(True)
    )


def decode_text(content: Column) -> Column:
    """UTF-8 text of a BINARY column without its undecodable bytes."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def _load(reader, root: str, include_patterns: Sequence[str] | None, skip_rules: bool,
          split_bytes: int, content: bool) -> DataFrame:
    return reader.format(tree.FORMAT).option("include", json.dumps(list(include_patterns or ()))
        ).option("skipRules", str(skip_rules)).option("splitBytes", split_bytes
        ).option("content", str(content)).load(tree.base_uri(root))


def list_tree(spark: SparkSession, root: str, skip_rules: bool = True,
              include_patterns: Sequence[str] | None = None) -> DataFrame:
    """(path, size_bytes, modified) of every file below a folder; none is opened."""
    tree.register(spark)
    return _load(spark.read, root, include_patterns, skip_rules, tree.SPLIT_BYTES, False)


def read_tree(
    spark: SparkSession,
    root: str,
    repo_id: str | None = None,
    include_patterns: Sequence[str] | None = None,
    skip_rules: bool = True,
    catalog: str = "scanner",
    split_bytes: int = tree.SPLIT_BYTES,
) -> DataFrame:
    """Files below a folder: one row per file with text, or an error.

    Path rules, and filters on path or size, choose files before any is opened;
    ``skip_rules=False`` walks everything.  Files are dealt to tasks by bytes, so a large folder is
    many tasks.
    """
    tree.register(spark)
    raw = _load(spark.read, root, include_patterns, skip_rules, split_bytes, True)
    return _described(raw, repo_id or tree.base_uri(root).rsplit("/", 1)[-1], catalog)


def read_tree_stream(
    spark: SparkSession,
    root: str,
    repo_id: str | None = None,
    include_patterns: Sequence[str] | None = None,
    skip_rules: bool = True,
    catalog: str = "scanner",
    split_bytes: int = tree.SPLIT_BYTES,
) -> DataFrame:
    """The same rows as a stream: files that are new or changed since the last micro-batch.

    A file counts as new by its modification time, so one that is moved in with an old
    time is not seen.
    """
    tree.register(spark)
    raw = _load(spark.readStream, root, include_patterns, skip_rules, split_bytes, True)
    return _described(raw, repo_id or tree.base_uri(root).rsplit("/", 1)[-1], catalog)


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``content`` (text or bytes) of each row to the file ``path`` below a folder."""
    tree.register(files.sparkSession)
    files.select("path", "content").write.format(tree.FORMAT).mode("append").save(
        tree.base_uri(root))


def _described(raw: DataFrame, name: str, catalog: str) -> DataFrame:
    binary = is_binary(F.col("content"))
    return raw.select(
        F.xxhash64(F.lit(name), F.col("path")).alias("file_id"),
        F.lit(name).alias("repo_id"),
        "path",
        detect_language(F.col("path"), catalog).alias("language"),
        F.when(~binary, decode_text(F.col("content"))).alias("content"),
        "size_bytes",
        F.timestamp_micros("modified").alias("last_modified"),
        F.coalesce("error", F.when(binary, F.lit("binary file"))).alias("error"),
    ).withColumn("hash", F.md5(F.col("content")))


def cap_files(
    files: DataFrame,
    max_bytes: int,
    max_files: int,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Files small enough, of a supported language, first ones by path per repository.

    The rank filter prunes inside each task before the shuffle, so a
    repository with very many files sends at most ``max_files`` rows per task.
    """
    supported = tuple(languages or C.SCANNER_LANGUAGES)
    w = W.partitionBy("repo_id").orderBy("path")
    return (
        files.filter(F.octet_length("content") <= max_bytes)
        .filter(F.col("language").isin(*supported))
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= max_files)
        .drop("__rn")
    )


def file_errors(files: DataFrame) -> DataFrame:
    """What the scan reports instead of findings: unknown or unparsed files."""
    known = F.col("language").isNotNull()
    parsed = F.col("language").isin(*C.PARSED_LANGUAGES)
    message = F.when(~known, F.concat(F.lit("Unknown file type: "), F.col("path"))).otherwise(
        F.concat(F.lit("Parser not available for "), F.col("language"))
    )
    return files.filter(~known | ~parsed).select("file_id", "path", message.alias("error"))
