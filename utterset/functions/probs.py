"""Probability post-processing on array columns (PX-18..PX-21, SO-3).

All higher-order functions: they run inside the JVM on each row's array, no
Python. Index positions are 0-based in outputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_softmax(df, logits: str, out: str = "p"):
    """PX-18: add the numerically stable softmax of a numeric array column.

    Built in stages (max, exponentials, sum, ratio) as separate columns so that
    each array is computed once per row; nesting them in one lambda would
    recompute the inner arrays for every element.
    """
    df = df.withColumn("__x", F.transform(F.col(logits), lambda v: v.cast("double")))
    df = df.withColumn("__m", F.array_max("__x"))
    df = df.withColumn("__e", F.transform("__x", lambda v: F.exp(v - F.col("__m"))))
    df = df.withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda a, v: a + v))
    return df.withColumn(out, F.transform("__e", lambda v: v / F.col("__s"))).drop("__x", "__m", "__e", "__s")


def argmax(arr) -> Column:
    """PX-19: 0-based index of the largest element, first one on ties."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def rounded(arr, digits: int = 4) -> Column:
    return F.transform(_c(arr), lambda v: F.round(v, digits))


def prob_map(labels: list[str], probs, digits: int = 4) -> Column:
    """PX-20: ``label -> round(prob, 4)``; label count must equal array size
    (the reference's zip silently truncates, we fail the row instead)."""
    p = _c(probs)
    lab = F.array(*[F.lit(x) for x in labels])
    checked = F.when(F.size(p) == len(labels), p).otherwise(F.raise_error(F.lit("label count != probability count")))
    return F.map_from_arrays(lab, rounded(checked, digits))


def top_k(probs, k: int = 2, digits: int = 4) -> Column:
    """SO-3: the k largest rounded probabilities as ``array<struct<idx, prob>>``,
    ties by index (a stable sort on the rounded values, as the reference)."""
    p = rounded(probs, digits)
    items = F.transform(p, lambda v, i: F.struct((-v).alias("neg"), i.alias("idx"), v.alias("prob")))
    ordered = F.array_sort(items)
    return F.slice(F.transform(ordered, lambda s: F.struct(s["idx"].alias("idx"), s["prob"].alias("prob"))), 1, k)
