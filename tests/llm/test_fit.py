"""The classifier's fit in the driver: bounded temporary memory, and the sums of one pass."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from codeshoal.llm import toxicity


def plain_weights(rows, toxic, ratio, penalty, steps):
    """The same steps on all features of all rows at once."""
    n, positives = len(rows), toxic.sum()
    owner, flat = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    value = ratio[flat] / np.sqrt(np.maximum(np.bincount(owner, ratio[flat] ** 2, n), 1e-12))[owner]
    weigh = np.where(toxic, 0.5 / positives, 0.5 / (n - positives))
    coef, ahead, bias, ahead_bias, pace = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0, 1.0
    for _ in range(steps):
        margin = np.bincount(owner, ahead[flat] * value, n) + ahead_bias
        error = weigh * (1 / (1 + np.exp(-margin)) - toxic)
        slope = np.bincount(flat, error[owner] * value, len(ratio)) + penalty * 1e-2 * ahead
        new, new_bias = ahead - slope / (0.5 + penalty), ahead_bias - error.sum() / (0.5 + penalty)
        following = (1 + (1 + 4 * pace ** 2) ** 0.5) / 2
        push = (pace - 1) / following
        ahead, ahead_bias = new + push * (new - coef), new_bias + push * (new_bias - bias)
        coef, bias, pace = new, new_bias, following
    return coef * ratio, bias


def test_fit_keeps_one_number_of_a_feature_and_the_weights_of_a_plain_fit():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(2_000) < share).astype(np.int32)
            for share in (*rng.random(1_200), 0, 0)]
    toxic = (rng.random(len(rows)) < 0.4).astype(float)
    slots, ratio = np.arange(2_000, dtype=np.int64), rng.normal(size=2_000)
    tracemalloc.start()
    try:
        model = toxicity.fit(rows, toxic, slots, ratio, steps=4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * sum(map(len, rows))
    weight, bias = plain_weights(rows, toxic, ratio, 0.3, 4)
    np.testing.assert_allclose(model.weight, weight, rtol=1e-9, atol=1e-12)
    assert abs(model.bias - bias) < 1e-12


def test_rows_of_a_document_are_put_together():
    kinds = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()),
                       ("places", pa.list_(pa.int32()))])
    table = pa.concat_tables([
        pa.table([[7, 2, 7], [1, 0, 1], [[1, 9], [], [0, 4]]], schema=kinds),
        pa.table([[5, 2], [1, 0], [[3], [8]]], schema=kinds).slice(0, 2)])
    rows, marks = toxicity._by_document(table)
    assert [r.tolist() for r in rows] == [[8], [3], [0, 1, 4, 9]]
    assert marks.tolist() == [0, 1, 1]
    rows, marks = toxicity._by_document(table.slice(0, 0))
    assert rows == [] and marks.tolist() == []
