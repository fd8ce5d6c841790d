"""Corpus sources by file extension."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.corpus import weighted_mix


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: Any = None) -> DataFrame:
    """One JSON object per line; give a schema to skip inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_json(spark: SparkSession, path: str, schema: Any = None) -> DataFrame:
    """A list of objects, or an object whose fields are equally long columns."""
    reader = spark.read.option("multiLine", "true")
    df = reader.schema(schema).json(path) if schema is not None else reader.json(path)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    # A dict of columns reads as one row of arrays only, and so does a list of one such object.
    if arrays and len(arrays) == len(df.schema.fields) and _one_row(df) and not _listed(spark, path):
        return df.select(F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))
    return df


def _listed(spark: SparkSession, path: str) -> bool:
    """Whether the JSON text is a list."""
    opening = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("value", r"^\s*(\S)", 1).alias("c")).first()
    return opening is not None and opening["c"] == "["


def _one_row(df: DataFrame) -> bool:
    return len(df.select(F.lit(1)).take(2)) == 1


def load_source(
    spark: SparkSession,
    path: str | None,
    schema: Any = None,
    on_missing: str = "skip",
) -> DataFrame | None:
    """Reader chosen by extension; a missing path is skipped or an error."""
    if not path or not path_exists(spark, path):
        if on_missing == "fail":
            raise FileNotFoundError(f"Dataset not found: {path}")
        warnings.warn(f"Dataset not found: {path}", stacklevel=2)
        return None
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return read_json(spark, path, schema)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    try:
        return spark.read.load(path)
    except AnalysisException as error:
        warnings.warn(f"Failed to load dataset {path}: {error}", stacklevel=2)
        return None


def load_mix(spark: SparkSession, sources: Sequence[dict], key: str) -> DataFrame:
    """Weighted mix of sources given as dicts with path and optional weight."""
    loaded = []
    for source in sources:
        df = load_source(spark, source.get("path"), source.get("schema"))
        if df is not None:
            loaded.append((df, float(source.get("weight", 1.0))))
    if not loaded:
        raise ValueError("none of the sources could be loaded")
    return weighted_mix(loaded, key)


def load_preferences(spark: SparkSession, path: str | None, schema: Any = None) -> DataFrame:
    """Preference rows from JSON lines; a missing file is an error."""
    if not path or not path_exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    return read_jsonl(spark, path, schema)
