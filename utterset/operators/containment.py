"""Held-out leakage: which documents contain a benchmark passage verbatim
(the containment form of JN-3).

A theta join ``contains(doc, item)`` would compare every pair. Instead both
sides are reduced to *winnowed* k-gram fingerprints (Schleimer et al., SIGMOD
2003): hash every k-character gram, keep the minimum of each window of ``w``
consecutive hashes. Selection is local, so every fingerprint an item selects
is also selected in any document that contains the item. Hence:

1. fingerprint documents and items (vectorised numpy in an Arrow UDF);
2. count, per item fingerprint, the documents that have it (a semi join to
   the item fingerprint set first, so only relevant rows are aggregated);
3. each item keeps its single rarest fingerprint (a document without it
   cannot contain the item) -> an equi-join yields the few candidates;
4. candidates are verified exactly with ``instr``.

Items shorter than ``k + w - 1`` characters have no guaranteed fingerprint; each is
looked for by the one of its pieces of 8, 4, 2 or 1 characters that the fewest documents
have (``dictionary``), in an equi-join, and verified in the same way. Any number of them
will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..functions.batches import by_slices
from ..session import cut_lineage, ensure_shipped

from .dictionary import BROADCAST_ROWS, all_pieces, anchors
from .rank import bounded_broadcast

K_GRAM = 16
WINDOW = 32
_BASE = np.uint64(1099511628211)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fingerprints(text: str | None, k: int, w: int) -> np.ndarray:
    if not text or len(text) < k:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = codes[: len(codes) - k + 1].copy()
    for i in range(1, k):
        h *= _BASE
        h += codes[i : len(codes) - k + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    if len(h) < w:
        sel = np.array([h.min()], dtype=np.uint64)
    else:
        sel = np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)
    return np.unique(sel).view(np.int64)


def fingerprint_udf(k: int = K_GRAM, w: int = WINDOW):
    kind = pa.list_(pa.int64())

    def lists(texts: list) -> pa.Array:
        held = [_fingerprints(t, k, w) for t in texts]
        ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_slices(lists, texts, kind)
    return fp


def contained_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                    text_col: str = "text", k: int = K_GRAM, w: int = WINDOW) -> DataFrame:
    """``(item_id, doc_id)`` for every document whose text contains the item's text."""
    ensure_shipped(docs.sparkSession)
    fp = fingerprint_udf(k, w)
    min_len = k + w - 1
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("doc_text"))
    it = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("item_text")) \
        .filter(F.col("item_text").isNotNull() & (F.length("item_text") > 0))
    long_items = it.filter(F.length("item_text") >= min_len)
    short_items = it.filter(F.length("item_text") < min_len)

    item_fp = long_items.select("item_id", F.explode(fp("item_text")).alias("fp"))
    doc_fp = d.select("doc_id", F.explode(fp("doc_text")).alias("fp"))
    wanted = bounded_broadcast(item_fp.select("fp").distinct())
    # only fingerprints some item has; read by two branches, so cut the
    # lineage once (shared checkpoint folder) instead of fingerprinting twice
    relevant = cut_lineage(doc_fp.join(wanted, "fp", "left_semi"))
    freq = relevant.groupBy("fp").agg(F.count(F.lit(1)).alias("df"))
    scored = item_fp.join(freq, "fp", "left").fillna(0, ["df"])
    chosen = scored.groupBy("item_id").agg(F.min(F.struct("df", "fp")).alias("best")) \
        .select("item_id", F.col("best.fp").alias("fp"))
    cand = relevant.join(bounded_broadcast(chosen), "fp").select("item_id", "doc_id").distinct()
    verified = cand.join(d, "doc_id").join(long_items, "item_id") \
        .filter(F.instr(F.col("doc_text"), F.col("item_text")) > 0).select("item_id", "doc_id")

    if short_items.isEmpty():
        return verified
    rule = F.struct(F.lit(0).alias("priority"), F.lit("").alias("label"))  # all alike here
    texts = d.withColumnRenamed("doc_text", "__text")
    words = cut_lineage(short_items.select(F.col("item_text").alias("keyword")).distinct().withColumn("rule", rule))
    look = anchors(texts, words)
    sizes = [r["q"] for r in look.select("q").distinct().collect()]  # of PIECES
    if not sizes:
        return verified
    found = all_pieces(texts, "__text", sizes, "doc_id").join(bounded_broadcast(look, BROADCAST_ROWS), ["q", "piece"]).select("doc_id", "keyword").distinct()
    short = found.join(d, "doc_id").filter(F.instr(F.col("doc_text"), F.col("keyword")) > 0) \
        .join(short_items, F.col("keyword") == F.col("item_text")).select("item_id", "doc_id")
    return verified.unionByName(short.distinct())
