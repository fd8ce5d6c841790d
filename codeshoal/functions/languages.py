"""Language, MIME and name lookups over file paths."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogs as C


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' where there is none.

    A leading dot does not start a suffix (``.profile`` has none) and neither
    does a trailing one.
    """
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def _first_match(catalog: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Key -> language, the earlier catalog entry winning."""
    table: dict[str, str] = {}
    for language, keys in catalog.items():
        for key in keys:
            table.setdefault(key, language)
    return table


def _lookup(table: dict[str, str], key: Column) -> Column:
    """CASE over a closed table: stays in generated code, no join."""
    by_value: dict[str, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    expr = None
    for value, keys in by_value.items():
        cond = key.isin(*keys)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if expr is not None else F.lit(None).cast("string")


def detect_language(path: Column, catalog: str = "scanner") -> Column:
    """Language of a path, or NULL.

    ``scanner`` maps ``.h`` to cpp and ignores names; ``extended`` maps it to c
    and also knows bare names such as ``Dockerfile``.
    """
    if catalog == "scanner":
        return _lookup(_first_match(C.SCANNER_LANGUAGES), suffix(path))
    table = _first_match(C.EXTENDED_LANGUAGES)
    return F.coalesce(_lookup(table, suffix(path)), _lookup(table, base_name(path)))


def primary_extension(language: Column) -> Column:
    return _lookup({k: v[0] for k, v in C.EXTENDED_LANGUAGES.items()}, language)


def mime_table() -> list[tuple[str, str]]:
    """Extension -> MIME type, from the standard library's own default table."""
    return sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items())


def with_mime_type(files: DataFrame, path: str = "path", out: str = "mime") -> DataFrame:
    """Add a MIME type by extension, ``application/octet-stream`` by default.

    The lookup has a fixed number of rows (the standard table), so it is
    broadcast and hashed once per executor.  Compression suffixes are peeled
    first: ``a.tar.gz`` is looked up as ``a.tar``.
    """
    spark: SparkSession = files.sparkSession
    table = F.broadcast(
        spark.createDataFrame(mime_table(), "__ext string, __mime string")
    )
    encodings = "|".join(e[1:] for e in sorted(mimetypes.MimeTypes(filenames=()).encodings_map))
    expanded = base_name(F.col(path))
    for short, long in sorted(mimetypes.MimeTypes(filenames=()).suffix_map.items()):
        expanded = F.regexp_replace(expanded, rf"(?i)(?<=.)\{short}$", long)
    peeled = F.regexp_replace(expanded, rf"(?<=.)\.(?:{encodings})$", "")
    keyed = files.withColumn("__key", F.lower(F.regexp_extract(peeled, r"(?s)^.+(\.[^.]+)$", 1)))
    joined = keyed.join(table, keyed["__key"] == table["__ext"], "left")
    return joined.withColumn(
        out, F.coalesce("__mime", F.lit("application/octet-stream"))
    ).drop("__key", "__ext", "__mime")


def language_catalog(spark: SparkSession, variant: str = "listing") -> DataFrame:
    """The language tables as a DataFrame (language, title, extensions)."""
    if variant == "listing":
        rows = [(i, t, list(e)) for i, t, e in C.LISTED_LANGUAGES]
    else:
        source = C.SCANNER_LANGUAGES if variant == "scanner" else C.EXTENDED_LANGUAGES
        rows = [(k, k, list(v)) for k, v in source.items()]
    return spark.createDataFrame(rows, "language string, title string, extensions array<string>")
