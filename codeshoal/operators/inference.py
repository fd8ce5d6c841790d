"""Batch inference over tables with user callables.

Spark partitions the rows; a callable sees one batch of texts at a time, is
built once per task, and a failing row comes back with its error.  An Arrow batch is
taken apart by its bytes: only about SLICE of them are Python objects at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BATCH = 4
# Bytes of texts that become Python objects at a time.
SLICE = 1 << 20
Model = Callable[[list[str]], list[str]]


def _as_many(answers: Sequence, n: int) -> Sequence:
    """The answers, if there is one for each input; rows would be lost or mixed up else."""
    if len(answers) != n:
        raise ValueError(f"{len(answers)} answers for {n} inputs")
    return answers


def _sliced(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """The same rows, about SLICE bytes of the texts ``source`` at a time (a larger one alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_numpy()
        ends = np.cumsum(sizes.astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(start, end - start)
            start = end


def generate(
    prompts: DataFrame,
    load: Callable[[str], Model],
    default_model: str = "default",
    key: str = "id",
    max_batch_size: int = MAX_BATCH,
) -> DataFrame:
    """(key, text, model_used, error) for rows (key, prompt, model).

    ``load(name)`` returns a function from texts to texts; a model that cannot
    be loaded falls back to the default one.  A batch that fails is retried
    row by row, so one bad row spoils only itself.
    """
    key_type = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, tuple[str, Model]] = {}

        def resolve(name: str | None) -> tuple[str, Model]:
            wanted = name or default_model
            if wanted not in models:
                try:
                    models[wanted] = (wanted, load(wanted))
                except Exception:  # noqa: BLE001 - any loading failure falls back
                    if default_model not in models:
                        models[default_model] = (default_model, load(default_model))
                    models[wanted] = models[default_model]
            return models[wanted]

        for part in _sliced(batches, "prompt"):
            prompts_of: dict[str | None, list[int]] = {}
            for i, name in enumerate(part.column("model").to_pylist()):
                prompts_of.setdefault(name or None, []).append(i)
            given = part.column("prompt").to_pylist()
            rows: list[tuple] = []
            for name, places in prompts_of.items():
                used, model = resolve(name)
                for at in range(0, len(places), max_batch_size):
                    own = places[at:at + max_batch_size]
                    texts = [given[i] for i in own]
                    try:
                        answers = _as_many(model(texts), len(texts))
                        rows += [(i, t, used, None) for i, t in zip(own, answers)]
                    except Exception:  # noqa: BLE001
                        for i, text in zip(own, texts):
                            try:
                                rows.append((i, _as_many(model([text]), 1)[0], used, None))
                            except Exception as error:  # noqa: BLE001
                                rows.append((i, None, used, str(error)))
            place, *columns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(place, pa.int64()))]
                + [pa.array(c, pa.string()) for c in columns],
                names=[key, "text", "model_used", "error"])

    columns = [key, "prompt"]
    model = F.col("model") if "model" in prompts.columns else F.lit(None).cast("string")
    return prompts.select(*columns, model.alias("model")).mapInArrow(
        run, f"{key} {key_type}, text string, model_used string, error string"
    )


def embed(
    texts: DataFrame,
    load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
    key: str = "id",
    text: str = "text",
    batch: int = 100,
    max_chars: int | None = None,
) -> DataFrame:
    """(key, embedding): vectors of texts, at most ``batch`` per call, encoder loaded per task.

    Whole texts are encoded.  ``max_chars`` cuts them, for an encoder that takes no more
    and a caller who does not pass chunks.
    """
    key_type = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for rows in _sliced(batches, text):
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                given = part.column(text).to_pylist()
                found = _as_many(encode(given), len(given))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(
                        [[float(x) for x in v] for v in found], pa.list_(pa.float32()))],
                    names=[key, "embedding"])

    body = F.col(text) if max_chars is None else F.left(F.col(text), F.lit(max_chars))
    return texts.select(key, body.alias(text)).mapInArrow(
        run, f"{key} {key_type}, embedding array<float>"
    )


def score(
    pairs: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[float]]], *keys: str
) -> DataFrame:
    """Reward of query followed by response, for columns query and response."""
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", reward double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = load()
        for part in _sliced(batches, "__text"):
            rewards = _as_many(rate(part.column("__text").to_pylist()), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in keys]
                + [pa.array([float(r) for r in rewards], pa.float64())], names=[*keys, "reward"])

    text = F.concat(F.col("query"), F.col("response")).alias("__text")
    return pairs.select(*keys, text).mapInArrow(run, schema)


FINDING_COLUMNS = (
    "finding_type string, rule_id string, rule_name string, severity string, message string, "
    "line_start int, line_end int"
)


def run_analyzer(
    snippets: DataFrame,
    analyze: Callable[[str, str], list[dict]],
    key: str = "id",
) -> DataFrame:
    """Plug-in analyzer ``analyze(code, language) -> findings`` over snippets.

    Errors become rows of type ``error`` instead of failing the job.
    """
    names = [c.split()[0] for c in FINDING_COLUMNS.split(", ")]
    key_type = dict(snippets.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, "code"):
            at, rows = [], []
            for i, (code, language) in enumerate(zip(
                    part.column("code").to_pylist(), part.column("language").to_pylist())):
                try:
                    found = analyze(code, language)
                except Exception as error:  # noqa: BLE001
                    found = [{"finding_type": "error", "message": str(error)}]
                for item in found:
                    at.append(i)
                    rows.append([item.get(n) for n in names])
            out = pd.DataFrame(rows, columns=names)
            for name in ("line_start", "line_end"):
                out[name] = out[name].astype("Int32")
            kinds = [pa.int32() if n.startswith("line_") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(at, pa.int64()))]
                + [pa.array(out[n], kind, from_pandas=True) for n, kind in zip(names, kinds)],
                names=[key, *names])

    return snippets.select(key, "code", "language").mapInArrow(
        run, f"{key} {key_type}, {FINDING_COLUMNS}"
    )
