"""Hashed character n-grams of whole texts, as UTF-8 bytes with A-Z lower-cased, a window of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.shingles import _KEEP, _LOWER, binary_parts

#: Bytes that are hashed at once; bounds the memory for long texts.
WINDOW = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed_grams(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text number, bucket)`` arrays for all n-grams of the orders (8 bytes at most), grams with repeats."""
    data, offsets = binary_parts(column)
    shift = np.uint64(64 - bits)
    for at in range(0, len(data), WINDOW):
        part = _LOWER[data[at : at + WINDOW + 7]]
        size = min(WINDOW, len(data) - at)
        padded = np.zeros(len(part) + 8, np.uint8)
        padded[: len(part)] = part
        eights = np.ndarray((size,), "<u8", padded.data, strides=(1,))
        first, last = np.searchsorted(offsets, [at, at + size - 1], side="right") - 1
        ends = offsets[first + 1 : last + 2]
        sizes = np.diff(np.concatenate([[at], np.minimum(ends, at + size)]))
        text = np.repeat(np.arange(first, last + 1, dtype=np.int32), sizes)
        room = np.repeat(ends, sizes) - np.arange(at, at + size) if max(orders) > 1 else None
        for n in orders:
            bucket = (((eights & _KEEP[n]) + np.uint64(n)) * _ODD >> shift).astype(np.int64)
            if n == 1:
                yield text, bucket
            else:
                whole = room >= n
                yield text[whole], bucket[whole]
