"""Arrow batches in slices, so that a task holds a bounded number of characters as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice (or one row).
SLICE_BYTES = 1 << 20


def slices(batch, text, limit: int | None = None) -> Iterator:
    """Rows of ``batch`` (a record batch or an array) in slices of about ``limit`` bytes of ``text``,
    its column of strings. What a slice took goes back to the system before the next."""
    limit = limit or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, end - at)
        before, at = int(ends[end - 1]), end
        pa.default_memory_pool().release_unused()


def by_slices(run: Callable[[list], pa.Array], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """``run`` over the texts of an array, a slice at a time."""
    parts = [run(part.to_pylist()) for part in slices(texts, texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
