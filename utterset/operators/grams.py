"""Hashed character unigrams and bigrams of texts as counts, in Arrow batches (ML-4).

The same features as those of RegexTokenizer(pattern="") -> NGram(2) -> HashingTF over both:
tokens are UTF-16 units (half of a pair becomes "?"), a bigram is two with a blank between,
and a feature is the murmur3 hash of its UTF-8 bytes. Here units are numbers and each
distinct pair of a slice is hashed once, without a string for each gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Units of text a task counts at a time (or one text), cells of its table of counts, and distinct pairs hashed ahead.
SLICE_UNITS, CELLS, PAIRS = 1 << 19, 1 << 22, 1 << 18
SEED = np.uint32(42)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3(chars: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed murmur3 (x86, 32 bits) of byte strings of up to 7 bytes: ``chars`` (uint64, little-endian, zeros after ``size`` bytes)."""
    def mixed(k: np.ndarray) -> np.ndarray:
        return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    low, high = (chars & np.uint64(0xFFFFFFFF)).astype(np.uint32), (chars >> np.uint64(32)).astype(np.uint32)
    whole = size >= 4
    h = np.where(whole, _rotated(SEED ^ mixed(low), 13) * np.uint32(5) + np.uint32(0xE6546B64), SEED)
    h = h ^ mixed(np.where(whole, high, low)) ^ size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


@cache
def _utf8() -> tuple[np.ndarray, np.ndarray]:
    """For each UTF-16 unit its UTF-8 bytes as a little-endian number, and how many there are."""
    u = np.arange(1 << 16, dtype=np.uint64)
    u[0xD800:0xE000] = ord("?")
    size = np.where(u < 0x80, 1, np.where(u < 0x800, 2, 3)).astype(np.uint64)
    last, mid = np.uint64(0x80) | (u & np.uint64(0x3F)), np.uint64(0x80) | ((u >> np.uint64(6)) & np.uint64(0x3F))
    two = (np.uint64(0xC0) | (u >> np.uint64(6))) | last << np.uint64(8)
    three = (np.uint64(0xE0) | (u >> np.uint64(12))) | mid << np.uint64(8) | last << np.uint64(16)
    return np.where(size == 1, u, np.where(size == 2, two, three)), size


@cache
def _unigrams(num_features: int) -> np.ndarray:
    return np.mod(murmur3(*_utf8()).astype(np.int64), num_features)


def _bigrams(a: np.ndarray, b: np.ndarray, num_features: int) -> np.ndarray:
    chars, size = _utf8()
    shift = np.uint64(8) * size[a]
    joined = chars[a] | np.uint64(ord(" ")) << shift | chars[b] << (shift + np.uint64(8))
    return np.mod(murmur3(joined, size[a] + size[b] + np.uint64(1)).astype(np.int64), num_features)


def _pairs(units: np.ndarray, num_features: int) -> np.ndarray:
    """The features of all two units in a row."""
    present = np.flatnonzero(np.bincount(units, minlength=1 << 16))
    if len(present) ** 2 > min(PAIRS, 4 * len(units)):
        return _bigrams(units[:-1], units[1:], num_features)
    number = np.zeros(1 << 16, np.int64)
    number[present] = np.arange(len(present))
    table = _bigrams(np.repeat(present, len(present)), np.tile(present, len(present)), num_features)
    own = number[units]
    return table[own[:-1] * len(present) + own[1:]]


def counted(texts: list[str], num_features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, n, at, count)`` of the texts in slices: the number of the slice's first text, the
    distinct features of each text, and these features, rising in each text, with their counts."""
    most, at = max(1, CELLS // num_features), 0
    while at < len(texts):
        held, size = [], 0
        for text in texts[at:at + most]:
            data = text.encode("utf-16-le", "surrogatepass")
            if held and size + len(data) // 2 > SLICE_UNITS:
                break
            held.append(data)
            size += len(data) // 2
        lengths = np.array([len(x) // 2 for x in held])
        units = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
        owner = np.repeat(np.arange(len(held)) * num_features, lengths)
        key = [_unigrams(num_features)[units] + owner]
        if len(units) > 1:
            key.append((_pairs(units, num_features) + owner[1:])[owner[1:] == owner[:-1]])
        key = np.concatenate(key)
        if len(held) * num_features <= 64 * len(key):
            table = np.bincount(key, minlength=len(held) * num_features)
            cell = np.flatnonzero(table)
            count = table[cell]
        else:
            cell, count = np.unique(key, return_counts=True)
        yield at, np.bincount(cell // num_features, minlength=len(held)), cell % num_features, count
        at += len(held)
