"""Texts as flat Arrow and numpy arrays, for operators that work on whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


class Words(NamedTuple):
    """Words of several texts, flat. ``dictionary[codes[i]]`` is the i-th word, of text ``text[i]``."""

    codes: np.ndarray
    dictionary: pa.Array
    text: np.ndarray
    counts: np.ndarray  # words of each text


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``limit`` bytes of text and at most ``rows`` rows each, a row at least."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        stop = min(stop, start + rows) if rows else stop
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of characters other than space and U+0009 to U+000D; ``lower`` folds A-Z."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    encoded = flat.filter(full).dictionary_encode()
    text = parent.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, text, np.bincount(text, minlength=len(texts)))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of the UTF-8 bytes of each value."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.to_pylist()), dtype=np.uint64, count=len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words, so that sums of mixed words act as set digests."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of consecutive groups of the given sizes, with the end as last entry."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], starts[i]+1, ...``, ``lengths[i]`` of them, for all i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
