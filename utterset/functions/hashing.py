"""Portable deterministic draws and order keys.

The reference draws with unseeded ``random`` / NumPy generators, which no other
engine can reproduce. Every draw here is a pure function of (seed, row key,
slot) built from md5 / sha1, which Spark and DuckDB compute identically, so the
same numbers come out regardless of partitioning or engine:

* draw:      ``pmod(bigint(conv(substr(md5(seed|id|slot), 1, 8), 16, 10)), n)``
* order key: ``sha1(seed|key...)``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def hash_u32(seed, *parts) -> Column:
    """Unsigned 32-bit number from the first 8 hex digits of md5(seed|parts)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[_s(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def draw(seed, id_col, slot: str, n) -> Column:
    """Uniform-ish draw in ``[0, n)`` for row ``id_col`` and a named slot."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(hash_u32(seed, id_col, F.lit(slot)), n.cast("long"))


def order_key(seed, *keys) -> Column:
    """Seeded shuffle key (SO-4): sort by it instead of a random permutation."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[_s(k) for k in keys]))


def content_key(text_col, suffix) -> Column:
    """``sha1(text + suffix)``: the label-cache key (PX-13)."""
    suffix = suffix if isinstance(suffix, Column) else F.lit(suffix)
    return F.sha1(F.concat(_s(text_col), suffix))
