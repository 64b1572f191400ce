"""Benchmark decontamination: documents that hold a test item's passage go.

Candidates come from a size-partitioned MinHash containment search over whole
documents (``containment``), verified by exact shingle counts.

Edge cases: documents and items that are null, empty or without words match nothing;
rows of one ``doc_id`` are one document and go together; rows without an id are judged one
by one; repeated rows go or stay together; an empty table on either side leaves every
document. Columns of either table may clash: only the ids and texts are
looked at, and documents keep all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import contained, contained_rows
from .tables import stored

#: Leaky rows (an id and a hash) up to which they are broadcast.
BROADCAST_LEAKS = 1 << 20


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(doc_id, item_id, containment, first_word, last_word)`` for all leaks."""
    return contained(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), "doc_id", "item_id", threshold)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, broadcast_leaks: int = BROADCAST_LEAKS) -> DataFrame:
    """The rows of ``docs`` whose document has no leak."""
    found = contained_rows(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), "doc_id", "item_id", threshold)
    leaky = F.col("doc.doc_id")
    found = stored(found.select(leaky.alias("leaky_id"), F.when(leaky.isNull(), F.col("doc.h")).alias("leaky_hash")).distinct(), "leaky")
    held = F.broadcast(found) if found.count() <= broadcast_leaks else found
    own_hash = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"]))
    return docs.join(held, docs["doc_id"].eqNullSafe(held["leaky_id"]) & own_hash.eqNullSafe(held["leaky_hash"]), "left_anti")
