"""Order-preserving deduplication (WN-1, WN-2) and question-log cleaning.

pandas keeps the *first* occurrence in frame order; Spark has no frame order,
so every function takes the column(s) that define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space


def first_by_key(df: DataFrame, key_cols, order_col: str) -> DataFrame:
    """One row per key: the row with the smallest ``order_col`` (WN-1/WN-2).

    Implemented as ``min(order)`` (hash aggregate) or ``min(struct(order,
    row))`` when other columns ride along -- partial aggregation runs before
    the shuffle either way, so a key holding a third of all rows costs one
    small partial state per map task.
    """
    keys = list(key_cols)
    others = [c for c in df.columns if c not in keys and c != order_col]
    if not others:
        # only the order rides along: a plain min is a (codegen'd) hash aggregate
        return df.groupBy(*keys).agg(F.min(order_col).alias(order_col))
    # other columns ride along in a struct; a struct buffer makes Spark use a
    # sort-based aggregate (still partial before the shuffle)
    packed = F.struct(F.col(order_col).alias("o"), *[F.col(c).alias(c) for c in others])
    out = df.groupBy(*keys).agg(F.min(packed).alias("__m"))
    return out.select(*keys, F.col("__m.o").alias(order_col), *[F.col(f"__m.{c}").alias(c) for c in others])


def clean_questions(log: DataFrame, text_col: str = "text", pos_col: str = "src_pos") -> DataFrame:
    """PX-2 + FL-1 + WN-1: normalise whitespace, drop empty, keep first copy.

    Nulls are dropped (the reference turns them into the text "nan").
    Returns ``(src_pos, text)`` with one row per distinct normalised text.
    """
    norm = log.select(F.col(pos_col).alias("src_pos"), collapse_space(F.col(text_col)).alias("text")) \
        .filter(F.col("text").isNotNull() & (F.length("text") > 0))
    return first_by_key(norm, ["text"], "src_pos").select("src_pos", "text")
