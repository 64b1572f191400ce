"""Label dictionaries: stable ids, last-wins maps, unknown-label checks.

Label tables are small (one row per class) and are broadcast only after a
row-count check; the labelled rows themselves never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_upper
from ..session import cut_lineage
from .rank import bounded_broadcast

#: Unknown labels that the error names.
NAMED_LABELS = 100


def normalize_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """PX-5: strip and upper-case the label column."""
    return df.withColumn(label_col, strip_upper(F.col(label_col)))


def label_index(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """A fresh index: distinct labels in sorted order, ids 0..k-1."""
    d = labels.select(F.col(label_col).alias("label")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("label")  # one row per class: tiny
    return d.select("label", (F.row_number().over(w) - 1).cast("int").alias("label_idx"))


def extend_label_index(existing: DataFrame | None, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """WN-6: existing labels keep their ids; unseen labels are appended in
    sorted order after the largest existing id."""
    if existing is None:
        return label_index(labels, label_col)
    seen = labels.select(F.col(label_col).alias("label")).distinct()
    new = seen.join(existing.select("label"), "label", "left_anti")
    top = existing.agg(F.max("label_idx")).first()[0]  # one scalar
    top = -1 if top is None else int(top)
    w = Window.partitionBy(F.lit(0)).orderBy("label")  # new classes only: tiny
    appended = new.select("label", (F.lit(top) + F.row_number().over(w)).cast("int").alias("label_idx"))
    return existing.select("label", F.col("label_idx").cast("int")).unionByName(appended)


def label_map_last_wins(df: DataFrame, id_col: str, name_col: str, pos_col: str) -> DataFrame:
    """AG-7: ``id -> name``, where a repeated id keeps the name whose first
    appearance (by ``pos_col``) is latest -- dict-building over the
    de-duplicated (id, name) pairs in order, as the reference does."""
    pairs = df.groupBy(id_col, name_col).agg(F.min(pos_col).alias("__first"))
    return pairs.groupBy(id_col).agg(F.max_by(F.col(name_col), F.col("__first")).alias(name_col))


def inverse_map_last_wins(df: DataFrame, id_col: str, name_col: str, pos_col: str) -> DataFrame:
    """AG-7 inverse: ``name -> id`` from the id map. The id map is ordered by
    each id's first appearance, so for a repeated name the id seen last wins."""
    pairs = df.groupBy(id_col, name_col).agg(F.min(pos_col).alias("__first"))
    fwd = pairs.groupBy(id_col).agg(F.max_by(F.col(name_col), F.col("__first")).alias(name_col),
                                    F.min("__first").alias("__id_first"))
    return fwd.groupBy(name_col).agg(F.max_by(F.col(id_col), F.col("__id_first")).alias(id_col))


def unknown_labels(df: DataFrame, known: DataFrame, label_col: str = "label") -> DataFrame:
    """FL-4 / AG-10: labels missing from ``known`` with their row counts."""
    k = bounded_broadcast(known.select(F.col(known.columns[0]).alias(label_col)).distinct())
    return df.join(k, label_col, "left_anti").groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))


def require_known_labels(df: DataFrame, known: DataFrame, label_col: str = "label") -> DataFrame:
    """FL-4: fail the job with the number of unknown labels and of their rows, and the
    names and counts of the first ``NAMED_LABELS``; ``unknown_labels`` has them all."""
    bad = cut_lineage(unknown_labels(df, known, label_col))
    total = bad.agg(F.count(F.lit(1)).alias("labels"), F.sum("count").alias("rows")).first()
    if total["labels"]:
        first = {r[label_col]: r["count"] for r in bad.orderBy(label_col).limit(NAMED_LABELS).collect()}
        raise ValueError(f"{total['labels']} labels of {total['rows']} rows are not in the label table; the first: {first}")
    return df


def attach_label_ids(df: DataFrame, index: DataFrame, label_col: str = "label") -> DataFrame:
    """JN-4 / PX-17: label string -> integer id through the label table."""
    idx = bounded_broadcast(index.select(F.col("label").alias(label_col), "label_idx"))
    return df.join(idx, label_col, "inner")
