"""Vectorised word and shingle hashes over Arrow batches of texts.

Words are the maximal runs of characters other than the six ASCII blanks
(``[^\\x20\\x09-\\x0D]+``). A word's hash is a 64-bit polynomial over its bytes
with a final mix, a shingle's a polynomial over its words' hashes. Everything
works on bounded slices of a batch, so memory does not depend on how long a
partition is, only on ``CHUNK_BYTES`` and on the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE_KEYS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
WORD_BASE = U(0x9E3779B97F4A7C15)
SHINGLE_BASE = U(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """Words of consecutive texts: one hash per word, text i at offsets[i]:offsets[i+1]."""

    hashes: np.ndarray
    offsets: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of about ``max_bytes`` of text each, one row at least. Workers
    are reused, so what the slices' arrays leave in Arrow's pool is given back in between."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(size.astype(np.int64)) - 1).clip(0) // max_bytes
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and the texts' offsets into it; null counts as empty."""
    if lower:
        texts = pc.ascii_lower(texts)  # before the cast: a cast slice would come out garbled
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        words, starts = words.filter(pa.array(full)), before[starts]
    return words, starts


def hash_strings(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    words = words.cast(pa.large_string())
    n = len(words)
    if n == 0:
        return np.empty(0, U)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    length = np.diff(ends)
    out = np.zeros(n, U)
    if len(data):
        place = np.arange(len(data)) - np.repeat(ends[:-1], length)
        power = np.cumprod(np.concatenate((np.ones(1, U), np.full(int(length.max()), WORD_BASE, U))))
        term = BYTE_KEYS[data] * power[place]
        some = length > 0
        out[some] = np.add.reduceat(term, ends[:-1][some])
    return mix(out + length.astype(U) * SHINGLE_BASE)


def word_hashes(texts: pa.Array, lower: bool = False) -> Words:
    words, offsets = split_words(texts, lower)
    return Words(hash_strings(words), offsets)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words of one text, and for each text its
    offset into them (texts of fewer words have none)."""
    h, off = words
    n = len(h) - width + 1
    count = np.maximum(np.diff(off) - width + 1, 0)
    starts = np.concatenate(([0], np.cumsum(count)))
    if n <= 0 or starts[-1] == 0:
        return np.empty(0, U), np.zeros(len(off), np.int64)
    rolled = h[:n].copy()
    for k in range(1, width):
        rolled *= SHINGLE_BASE
        rolled += h[k : n + k]
    at = np.arange(starts[-1]) + np.repeat(off[:-1] - starts[:-1], count)
    return mix(rolled[at]), starts


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, and the texts' offsets. A text of
    fewer than ``width`` words has its whole sequence as its one shingle; one without
    words has none."""
    flat, starts = windows(words, width)
    n_words = np.diff(words.offsets)
    sets = []
    for i, n in enumerate(n_words):
        if n >= width:
            sets.append(np.unique(flat[starts[i] : starts[i + 1]]))
        elif n:
            part = np.array([n], U)
            for k in range(words.offsets[i], words.offsets[i + 1]):
                part = mix(part * SHINGLE_BASE + words.hashes[k : k + 1])
            sets.append(part)
        else:
            sets.append(np.empty(0, U))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def packed(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One little-endian binary value per text out of a flat array."""
    ends = np.asarray(offsets, np.int64) * flat.dtype.itemsize
    data = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
