"""Small helpers for higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Needed where a value is read inside a lambda: an inlined expression would
    be recomputed for every element.
    """
    return F.transform(F.array(value), body)[0]


def tally(text: Column, pattern: str) -> Column:
    """Number of matches of a regex."""
    return F.regexp_count(text, F.lit(pattern))


def occurrences(text: Column, char: str) -> Column:
    """Number of occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def struct_of(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def removed(text: Column, chars: str) -> Column:
    """How many of the given ASCII characters a text holds."""
    # Replacing compares bytes; translate looks every character up in a map.
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))
                for char in chars[1:]),
               F.octet_length(text) - F.octet_length(F.replace(text, F.lit(chars[0]), F.lit(""))))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep large expressions for as long as their Spark context lives.

    Expressions refer to columns by name only, so one object serves any number
    of queries; building it anew takes thousands of calls into the JVM.
    """
    kept: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args) -> Column:
        context = id(SparkContext._active_spark_context)
        if kept and next(iter(kept))[0] != context:
            kept.clear()
        key = (context, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get
