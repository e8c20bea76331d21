"""Words and word shingles of whole texts as arrays of 64-bit hashes, a batch of texts at a time.

A set of shingles is a sorted array of distinct hashes; the hash order is part of the global n-gram order.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words above this many bytes are hashed one by one.
_LONG = 128


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    return values ^ (values >> np.uint64(31))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets, nulls as empty; no copy."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, split at the six ASCII white-space bytes; and each text's first word."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    padded = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=padded[:n])
    inside = ~_SPACE[padded[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    eights = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    value = mixed((eights[starts] & _KEEP[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD)
    some, at = np.flatnonzero((lengths > 8) & (lengths <= _LONG)), 8
    while len(some):
        piece = eights[starts[some] + at] & _KEEP[np.minimum(lengths[some] - at, 8)]
        value[some] = mixed(value[some] * _ODD + piece)
        at += 8
        some = some[lengths[some] > at]
    for i in np.flatnonzero(lengths > _LONG):
        word = padded[starts[i] : starts[i] + lengths[i]].tobytes()
        value[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return value, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words is one shingle; null, empty and white-space texts have none.
    """
    words, first = word_hashes(*binary_parts(column))
    if not len(words):
        yield from (words for _ in range(len(column)))
        return
    value = np.full(max(0, len(words) - width + 1), np.uint64(width))
    for i in range(width):
        value = mixed(value * _ODD + words[i : i + len(value)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(value[a : b - width + 1])
        elif b > a:
            whole = np.full(1, np.uint64(b - a))
            for i in range(a, b):
                whole = mixed(whole * _ODD + words[i : i + 1])
            yield whole
        else:
            yield words[:0]


def set_digest(items: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int.from_bytes(blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)
