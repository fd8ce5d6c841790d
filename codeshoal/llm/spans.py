"""Tokens of Arrow text columns as byte positions, without a Python string each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of ASCII white space.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Bytes of letters: ASCII ones, and all of characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each text begins (and the end).

    A null text has no bytes.
    """
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes; a larger row is a range by itself."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, end
        start = end


def tokens(data: np.ndarray, offsets: np.ndarray, member: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest run of ``member`` bytes; no run crosses rows."""
    inside = member[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def cut(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end as an Arrow array of texts."""
    sizes = ends - starts
    stops = np.cumsum(sizes)
    places = np.repeat(starts - stops + sizes, sizes)
    places += np.arange(len(places))
    return strings(data[places], np.concatenate([[0], stops]))


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow array of texts from their bytes and offsets."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
        pa.py_buffer(np.ascontiguousarray(data, np.uint8)))
