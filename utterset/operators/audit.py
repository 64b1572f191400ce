"""Dataset audits: label counts, conflicts, exact overlap (AG-1..AG-4, JN-3, SE-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .split import group_key


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AG-1: rows per label, most frequent first (ties by label)."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), label_col)


def pair_counts(df: DataFrame, id_col: str = "label_id", name_col: str = "label_name") -> DataFrame:
    """AG-3: rows per (label_id, label_name); rows with a null key are dropped."""
    return df.dropna(subset=[id_col, name_col]).groupBy(id_col, name_col) \
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), id_col, name_col)


def conflicts(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """AG-4: whitespace-free texts that carry more than one distinct label.

    Distinct (key, label) pairs are formed first (partial aggregation), so the
    per-group label list is bounded by the number of labels, not by rows.
    """
    pairs = df.select(group_key(text_col).alias("norm_text"), F.col(label_col).alias("label")).distinct()
    g = pairs.groupBy("norm_text").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return g.filter(F.col("n_labels") > 1)


def exact_overlap(a: DataFrame, b: DataFrame, text_col: str = "text") -> DataFrame:
    """JN-3 / SE-3: distinct stripped texts present in both tables."""
    left = a.select(py_strip(F.col(text_col)).alias("text"))
    right = b.select(py_strip(F.col(text_col)).alias("text"))
    return left.intersect(right)


def column_mean_lengths(df: DataFrame) -> DataFrame:
    """AG-5: mean string length of every column in ONE aggregate pass;
    long form ``(col_pos, col_name, mean_len)``."""
    cols = df.columns
    aggs = [F.avg(F.length(F.col(c).cast("string"))).alias(f"__m{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col_name"),
                                         F.col(f"__m{i}").alias("mean_len")) for i, c in enumerate(cols)]))
    return one.select(stack.alias("s")).select("s.*")
