"""Two Bloom filters over all rows' hashes: bits of hashes seen once, and twice or more.

Every task turns its hashes into filter positions, split into sections; sections
with few positions travel as position lists, so a task never sends more than 5
bytes a hash and never more than the filter. A section's parts are merged in one
place: a position that two parts (or two rows of one part) set is seen twice. The
second filter therefore has no false negatives: all positions of a hash in two
rows are in it. Its size is fixed by ``bits``; with more hashes than that its false
positives grow, the exact step after it gets more rows, and results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordops import mix

HASHES = 2
SECTION_BITS = 1 << 20


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` filter positions of each hash, one row for each position."""
    mask = np.uint64(bits - 1)
    second = mix(hashes + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * second) & mask for k in range(HASHES)])


def _part(places: np.ndarray) -> bytes:
    """Sorted distinct positions of one section as compressed gaps."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _sections(once: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    for s in np.unique(once >> 20):
        part = [x[slice(*np.searchsorted(x, [s << 20, (s + 1) << 20]))] - (s << 20) for x in (once, twice)]
        yield int(s), _part(part[0]), _part(part[1])


def _places(part: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(part), "<u4").astype(np.int64))


def repeated(df: DataFrame, row_hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int,
             flush: int = 1 << 21) -> RepeatFilter:
    """The filter of hashes that two or more rows of ``df`` have.

    ``row_hashes(batch)`` yields arrays of hashes in which a row's hash stands once
    (so a hash twice in an array is in two rows). ``flush``: hashes that a task holds
    before it sends their positions on."""

    def sections(batches):
        held, n = [], 0

        def sent():
            low, high = [], []
            for place in positions(np.concatenate(held), bits):
                value, count = np.unique(place.astype(np.int64), return_counts=True)
                low.append(value)
                high.append(value[count > 1])
            once = np.unique(np.concatenate(low))
            rows = list(_sections(once, np.unique(np.concatenate(high))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["section", "once", "twice"])

        for batch in batches:
            for hashes in row_hashes(batch):
                held.append(hashes)
                n += len(hashes)
                if n >= flush:
                    yield from sent()
                    held, n = [], 0
        if n:
            yield from sent()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(SECTION_BITS, bool), np.zeros(SECTION_BITS, bool)
        for batch in batches:
            for one, two in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                place = _places(one)
                twice[place[once[place]]] = True
                twice[_places(two)] = True
                once[place] = True
        packed = zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1) if twice.any() else None
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())],
                                         names=["section", "bits"])

    parts = df.mapInArrow(sections, "section int, once binary, twice binary")
    found = parts.groupBy("section").applyInArrow(merged, "section int, bits binary").filter("bits is not null")
    # At most bits / 2^20 rows and bits / 8 bytes, whatever the input's size.
    rows = {r["section"]: r["bits"] for r in found.toLocalIterator()}
    return RepeatFilter(df.sparkSession.sparkContext.broadcast(rows), bits)


class RepeatFilter:
    """The broadcast second filter; ``test`` runs in tasks."""

    def __init__(self, sections, bits: int):
        self.sections, self.bits, self.dense = sections, bits, None

    def __getstate__(self):
        return {"sections": self.sections, "bits": self.bits, "dense": None}

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """True for each hash that may be in two rows; never false for one that is."""
        if self.dense is None:
            self.dense = np.zeros(self.bits >> 3, np.uint8)
            for s, part in self.sections.value.items():
                self.dense[s << 17 : (s + 1) << 17] = np.frombuffer(zlib.decompress(part), np.uint8)
        out = np.ones(len(hashes), bool)
        for place in positions(hashes, self.bits):
            place = place.astype(np.int64)
            out &= (self.dense[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return out
