"""Bindings from the driver's tables to the logical inputs of the toolkit.

* question log  -- ``conversations`` user turns; order = (conv_id, turn) packed
  into one BIGINT ``src_pos = conv_id * 2^20 + turn`` (turns < 2^20).
* labelled set  -- ``documents`` joined to ``labels``; label ``Q<quality>_T<toxic>``.
* source-labelled set -- ``documents`` with ``source`` as the label: it has
  conflicting labels for equal texts, which the audit operators need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

TURN_BITS = 20


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        (F.shiftleft(F.col("conv_id"), TURN_BITS) + F.col("turn")).alias("src_pos"),
        F.col("text"))


def labelled_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, label)``: documents with a quality/toxicity label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("Q"), F.col("quality").cast("string"),
                           F.lit("_T"), F.col("toxic").cast("string")).alias("label"))
    # labels covers a subset of documents; both sides grow with the data, so
    # this is a plain equi-join on doc_id (AQE picks broadcast if small at runtime).
    return docs.join(labels, "doc_id", "inner")


def source_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, label)`` with ``source`` as the label."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("label"))


def lang_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, y)``: documents with their language as the true class."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("y"))
