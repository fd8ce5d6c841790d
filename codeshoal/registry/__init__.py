"""All registered queries: name -> (query, SQL twin or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "text_queries",
    "scan_queries",
    "finding_queries",
    "graph_queries",
    "request_queries",
    "corpus_queries",
    "stream_queries",
)


def registered() -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in import_module(f"{__name__}.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found
