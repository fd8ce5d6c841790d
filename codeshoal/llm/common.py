"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import scratch_dir
from .spans import slices

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of a column that become Python objects at a time.
SLICE = 1 << 20


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    It cuts the lineage without tying results to an executor: the files lie in
    the folder that ``spark.checkpoint.dir`` names.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (names ignore case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterable[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """The same rows, about SLICE bytes of column ``source`` at a time (a larger row alone)."""
    for batch in batches:
        column = batch.column(source)
        listed = pa.types.is_list(column.type)
        sizes = pc.list_value_length(column) if listed else pc.binary_length(column)
        sizes = pc.fill_null(sizes, 0).to_numpy().astype(np.int64)
        sizes = sizes * (column.type.value_type.bit_width // 8 if listed else 1)
        for start, end in slices(sizes + 16, SLICE):
            yield batch.slice(start, end - start)


def append_columns(df: DataFrame, schema: str, setup: Callable[[], Callable], source: str = "text"
                   ) -> DataFrame:
    """``df`` plus the columns of the DDL ``schema``, made from the texts of ``source``.

    ``setup()`` runs once in each task and gives a function from a list of texts (null
    ones as None) to one Arrow array or list for each new column.  It gets about SLICE bytes
    at a time, whatever a batch holds.  Columns of ``df`` that are named like new ones (names
    ignore case) give way to them.
    """
    fields = StructType.fromDDL(schema).fields
    added = to_arrow_schema(StructType(fields))
    new = {f.name.lower() for f in fields}
    kept = [i for i, column in enumerate(df.columns) if column.lower() not in new]
    names = [df.columns[i] for i in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = setup()
        for batch in sliced(batches, source):
            made = make(batch.column(source).to_pylist())
            arrays = [
                x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                for x, f in zip(made, added)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + arrays, names=names)

    return df.mapInArrow(run, StructType([df.schema.fields[i] for i in kept] + fields))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def chunks(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    part = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
