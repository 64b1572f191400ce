"""Reading and writing datasets and their side tables (IO-1..IO-8, IO-10).

Parquet is the default sink; CSV and JSON Lines are offered for exchange. The
reference writes one CSV file per split and one JSON document holding two
parallel arrays; at scale those become folders of part files, and the
two-array JSON becomes one JSON object per row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.labels import normalize_labels, require_known_labels
from ..session import path_exists
from .columns import training_text_column


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """IO-1: parquet / csv / json by name; CSV with header, quotes and multi-line fields."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("multiLine", True).option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def read_labelled_csv(spark: SparkSession, path: str, known: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """IO-2 + FL-2 + PX-5 + FL-4: ``(*keep, text, label)`` of a labelled CSV.

    The text column is the first present of the known names (else the job fails);
    rows with a null text or label are dropped, texts stripped, labels stripped and
    upper-cased; a label that the first column of ``known`` lacks fails the job."""
    df = read_table(spark, path, "csv")
    rows = df.select(*keep, F.col(training_text_column(df)).alias("text"), "label").dropna(subset=["text", "label"])
    return require_known_labels(normalize_labels(rows.withColumn("text", py_strip("text"))), known)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """IO-3 / IO-4 / SP-7: write parquet, CSV (header, no index) or JSON Lines."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # keep texts byte-exact: the writer trims whitespace unless told not to
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def read_existing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """IO-6: an existing dataset if its folder exists; ``None`` if absent.

    An unreadable dataset raises (the reference treats it as absent and then
    overwrites it, defect D12)."""
    if not path_exists(spark, path):
        return None
    return read_table(spark, path, fmt)


def write_splits(df: DataFrame, out_dir: str, fmt: str = "parquet") -> None:
    """SP-7: one folder per split value, readable with partition pruning."""
    write_table(df, os.path.join(out_dir, "dataset"), fmt, partition_by=["split"])


def write_artifacts(out_dir: str, artifacts: dict[str, DataFrame], fmt: str = "parquet") -> dict[str, str]:
    """IO-10: write several result tables of one run; returns their paths.

    Callers persist the shared input first so each table does not recompute it.
    """
    paths = {}
    for name, df in artifacts.items():
        p = os.path.join(out_dir, name)
        write_table(df, p, fmt)
        paths[name] = p
    return paths
