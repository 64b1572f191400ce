"""Generate -> split -> merge with the existing set -> write -> report (GE-4).

The generator route of the reference (SURVEY section 3.2, first half):

* generation is narrow (no shuffle); per-label 80/20 prefix split (SP-5);
* the existing train/test sets are merged only when both exist (SE-2), and an
  unreadable existing set fails the job instead of being overwritten (D12);
* the merged set, its JSON form and the label index are written as a new version and
  become current together, so that a crash leaves the old ones whole;
* the label index keeps existing ids and appends new labels sorted (WN-6);
* with ``dedup_first`` the fresh generation is de-duplicated on (text, label)
  before the split, so a repeated sentence cannot land in train and test (D8).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..session import cut_lineage

from ..operators import generate, labels, merge, split
from ..operators.dedup import first_by_key
from ..sources import io, versions


def generate_and_save(spark: SparkSession, out_dir: str, n_per_label: int = 100, label_subset=None,
                      seed: int = 42, merge_existing: bool = True, dedup_first: bool = False,
                      cross_split: bool = False) -> dict:
    gen = generate.generate(spark, n_per_label, label_subset, seed=seed)
    gen = gen.withColumn("pos", F.col("sample_idx"))
    if dedup_first:
        gen = first_by_key(gen.select("label", "text", "sample_idx", "pos"), ["text", "label"], "pos")
    new = split.per_label_prefix_split(gen, "label", "sample_idx", seed=seed) \
        .select("split", "text", "label", "pos")

    seen = versions.current(spark, out_dir)

    def existing(name: str) -> DataFrame | None:
        if not merge_existing:
            return None
        return versions.read_current(spark, out_dir, name) if seen else io.read_existing(spark, os.path.join(out_dir, name))

    old = existing("dataset")
    if old is not None and not {"train", "test"} <= {r["split"] for r in old.select("split").distinct().collect()}:
        old = None                           # the reference merges only when both splits exist
    if old is not None:
        old = old.select("split", "text", "label", "pos")
    merged = cut_lineage(merge.merge_splits(old, new, "pos", cross_split=cross_split))
    report = merge.merge_stats(old, new, merged) if old is not None else None

    existing_index = existing("label_mapping")
    index = labels.extend_label_index(existing_index, merged.select("label")) if merge_existing \
        else labels.label_index(merged.select("label"))

    versions.replace(spark, out_dir, {
        "dataset": (merged.select("split", "text", "label", "pos"), "parquet", ["split"]),
        "dataset_json": (merged.select("text", "label", "split"), "json", []),
        "label_mapping": (index, "parquet", []),
    }, seen)
    dist = merged.filter(F.col("split") == "train").groupBy("label").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy("label")
    return {"merged": merged, "report": report, "label_index": index, "train_distribution": dist}
