"""Merging a new labelled set into an existing one (SE-1, SE-2, AG-8).

Rows carry ``origin`` (0 existing, 1 new) and a position; the merge keeps the
first (existing before new, then by position) of every (split, text, label).
With ``cross_split=True`` new training rows that equal an existing test row are
dropped as well (the reference dedups each split separately, defect D7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_by_key


def merge_splits(existing: DataFrame | None, new: DataFrame, pos_col: str = "pos",
                 cross_split: bool = False) -> DataFrame:
    """``existing`` and ``new``: ``(split, text, label, pos, ...)``.

    Returns the merged rows with ``origin``. Without an existing set the new
    rows pass through untouched (no dedup), as in the reference.
    """
    if existing is None:
        return new.withColumn("origin", F.lit(1))
    if cross_split:
        old_test = existing.filter(F.col("split") == "test").select("text", "label").distinct()
        new_train = new.filter(F.col("split") == "train").join(old_test, ["text", "label"], "left_anti")
        new = new_train.unionByName(new.filter(F.col("split") != "train"))
    both = existing.withColumn("origin", F.lit(0)).unionByName(new.withColumn("origin", F.lit(1)))
    both = both.withColumn("__ord", F.struct(F.col("origin"), F.col(pos_col)))
    kept = first_by_key(both.drop("origin", pos_col), ["split", "text", "label"], "__ord")
    return kept.select("*", F.col("__ord.origin").alias("origin"), F.col(f"__ord.{pos_col}").alias(pos_col)) \
        .drop("__ord")


def merge_stats(existing: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """AG-8: per split, existing + new = merged, and how many were removed."""
    e = existing.groupBy("split").agg(F.count(F.lit(1)).alias("existing"))
    n = new.groupBy("split").agg(F.count(F.lit(1)).alias("new"))
    m = merged.groupBy("split").agg(F.count(F.lit(1)).alias("merged"))
    out = e.join(n, "split", "full").join(m, "split", "full").fillna(0, ["existing", "new", "merged"])
    return out.withColumn("removed", F.col("existing") + F.col("new") - F.col("merged"))
