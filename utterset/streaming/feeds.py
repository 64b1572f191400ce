"""Structured Streaming: scoring a text feed (ST-1) and merging labelled rows
into a dataset continuously (ST-2).

Scoring and ``merge_feed`` use the same DataFrame functions as the batch jobs, so a
stream over a table equals the batch run over it. ``merge_keyed_feed`` keeps the keys it
has seen as state instead of reading the table again for every batch. Sinks are file
tables with a checkpoint in the shared folder, so a restarted query resumes where it
stopped.
"""

from __future__ import annotations

import os

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import rules as R
from ..operators.dedup import first_by_key
from ..session import ensure_shipped, is_folder, path_exists

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_feed(spark: SparkSession, folder: str, schema, file_glob: str | None = None,
              max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file source; ``file_glob`` selects files inside ``folder``."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def table_feed(spark: SparkSession, folder: str, name: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """The parquet table ``name`` of ``folder`` as a feed: one file, or a folder of files."""
    path = os.path.join(folder, name)
    if is_folder(spark, path):
        return file_feed(spark, path, schema, max_files_per_trigger=max_files_per_trigger)
    return file_feed(spark, folder, schema, name, max_files_per_trigger)


def validate_texts(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """FL-6: a text of at least one character is valid; the rest are rejects."""
    ok = F.coalesce(F.length(text_col), F.lit(0)) >= 1
    return df.filter(ok), df.filter(~ok).withColumn("error", F.lit("text must not be empty"))


def score_feed(feed: DataFrame, rules_df: DataFrame, labels: list[str], out_path: str, reject_path: str,
               checkpoint: str, key_cols=("conv_id", "turn"), text_col: str = "text", seed: int = 42,
               available_now: bool = True):
    """ST-1: valid rows -> rule predictions, invalid rows -> rejects. Stateless,
    so each micro-batch is independent; returns the two started queries."""
    valid, rejects = validate_texts(feed, text_col)
    scored = R.score_rules(valid, rules_df, labels, text_col, seed=seed, with_probs=False) \
        .select(*key_cols, "intent", "confidence")
    w1 = scored.writeStream.format("parquet").option("path", out_path) \
        .option("checkpointLocation", os.path.join(checkpoint, "scored"))
    w2 = rejects.select(*key_cols, "error").writeStream.format("parquet").option("path", reject_path) \
        .option("checkpointLocation", os.path.join(checkpoint, "rejects"))
    if available_now:
        w1, w2 = w1.trigger(availableNow=True), w2.trigger(availableNow=True)
    return w1.start(), w2.start()


def merge_feed(feed: DataFrame, table_path: str, checkpoint: str, pos_col: str = "pos",
               available_now: bool = True):
    """ST-2: append only (text, label) pairs not yet in the table.

    Each micro-batch keeps its first row per (text, label), drops pairs the
    table already holds from *earlier* batches, and writes its rows into the
    partition ``batch_id=<id>`` with overwrite, so a retried batch replaces
    its own output instead of duplicating it.
    """
    spark = feed.sparkSession

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = first_by_key(batch.select("text", "label", pos_col), ["text", "label"], pos_col)
        if path_exists(spark, table_path):  # not before the first batch
            current = spark.read.schema("text string, label string, batch_id long").parquet(table_path).filter(F.col("batch_id") < batch_id) \
                .select("text", "label")
            fresh = fresh.join(current, ["text", "label"], "left_anti")
        fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table_path)

    w = feed.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _first_row(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row with the smallest ``pos`` in the first batch that holds a key; none if the key
    is one of the existing table (``old``), and none later."""
    known, best = state.exists, None
    for frame in frames:
        known = known or bool(frame["old"].any())
        here = frame.sort_values("pos", kind="stable").head(1)
        if best is None or here["pos"].iloc[0] < best["pos"].iloc[0]:
            best = here
    if not state.exists:
        state.update((True,))
    if not known:
        yield best[["text", "label", "pos"]]


def merge_keyed_feed(feed: DataFrame, table_path: str, checkpoint: str, existing: DataFrame | None = None, pos_col: str = "pos",
                     available_now: bool = True):
    """ST-2 with bounded work: append the (text, label) pairs that neither ``existing``
    (text, label) nor an earlier batch has.

    A batch looks up its own keys in a state store kept on the executors' disks and in
    the checkpoint; neither the table nor the keys of other batches are read, however
    large the table is. The keys of ``existing`` are written once beside the checkpoint
    and come into the state with the first batch. The file sink commits a batch once, also
    when it is retried."""
    spark = feed.sparkSession
    ensure_shipped(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    key = F.sha2("text", 256).alias("text_key")
    rows = feed.select(key, "label", F.col(pos_col).cast("long").alias("pos"), "text", F.lit(False).alias("old"))
    if existing is not None:
        seeds = os.path.join(checkpoint, "existing")
        if not path_exists(spark, os.path.join(seeds, "_SUCCESS")):
            known = existing.select(key, "label").distinct()
            known.select("*", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("old")) \
                .write.mode("overwrite").parquet(seeds)
        rows = rows.unionByName(spark.readStream.schema(rows.schema).parquet(seeds))
    fresh = rows.groupBy("text_key", "label").applyInPandasWithState(
        _first_row, "text string, label string, pos long", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    w = fresh.writeStream.format("parquet").outputMode("append").option("path", table_path).option("checkpointLocation", os.path.join(checkpoint, "query"))
    return (w.trigger(availableNow=True) if available_now else w).start()
