"""Audit train/dev leakage, re-split by group, re-audit.

    audit:     exact overlap (JN-3), near-duplicates on all rows (JN-5),
               label counts per side (AG-1)
    re-split:  conflicts (AG-4) -> dedup (text, label) -> group split (SP-6)
    re-audit:  leaked groups (JN-6) must be empty; exact and near overlap again

Every number is computed over all rows; the reference samples 200 x 200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.text import py_strip
from ..operators import audit, neardup, split
from ..session import cut_lineage


def audit_sides(train: DataFrame, dev: DataFrame, id_col: str = "id", threshold: float = 0.95) -> dict:
    """Exact overlap, near-duplicate dev rows and label counts of two sides."""
    return {
        "exact_overlap": audit.exact_overlap(train, dev).agg(F.count(F.lit(1)).alias("n")),
        "near_dup_rows": neardup.near_dup_count(dev.select(id_col, "text"), train.select(id_col, "text"),
                                                id_col, "text", threshold),
        "train_counts": audit.label_counts(train),
        "dev_counts": audit.label_counts(dev),
    }


def _sides(train: DataFrame, dev: DataFrame) -> DataFrame:
    return train.withColumn("__side", F.lit(0)).unionByName(dev.withColumn("__side", F.lit(1)))


def text_keys(df: DataFrame, seed: int = 42, text_col: str = "text") -> DataFrame:
    """``df`` with digests in place of its texts, so that shuffles carry no text: ``text_key`` of the
    stripped text, ``norm_text`` of the group key, which starts with the group's order key (SHA-1)."""
    norm = split.group_key(text_col)
    return df.select(*[c for c in df.columns if c != text_col], F.unhex(F.sha2(py_strip(text_col), 256)).alias("text_key"),
                     F.unhex(F.concat(order_key(seed, norm), F.sha2(norm, 256))).alias("norm_text"))


def key_order(seed: int = 42):
    """The order key of a group of ``text_keys``; that of a null text is made of the seed alone."""
    return F.coalesce(F.lower(F.hex(F.substring("norm_text", 1, 20))), order_key(seed))


def leak_report(train: DataFrame, dev: DataFrame, pos_col: str = "pos", seed: int = 42, n_folds: int = 5) -> DataFrame:
    """``(stage, measure, n)``: rows of both sides, texts on both and conflicting groups
    before the re-split by group; rows, texts and groups on both sides after it. The sides'
    texts are compared by digests; sides that went through ``text_keys`` will do."""
    train, dev = (df if "norm_text" in df.columns else text_keys(df, seed) for df in (train, dev))
    both = _sides(train, dev).withColumn("__ord", F.struct("__side", pos_col)).select("__ord", "label", "norm_text", "text_key")
    parts = cut_lineage(split.split_groups(both, key_order(seed), "label", "__ord", n_folds).select("split", "norm_text", "text_key"))
    labelled = both.select("norm_text", "label").distinct().groupBy("norm_text").agg(F.count(F.lit(1)).alias("n_labels"))
    sides = {"before": (train, dev), "after": tuple(parts.filter(F.col("split") == name) for name in ("train", "dev"))}

    def rows(stage: str, measure: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), F.lit(measure).alias("measure"), "n")

    out = rows("before", "conflicting_groups", labelled.filter("n_labels > 1")).union(rows("after", "leaked_groups", split.leaked_groups(parts)))
    for stage, (left, right) in sides.items():
        out = out.union(rows(stage, "train_rows", left)).union(rows(stage, "dev_rows", right)) \
            .union(rows(stage, "texts_on_both_sides", left.select("text_key").intersect(right.select("text_key"))))
    return out


def resplit(train: DataFrame, dev: DataFrame, pos_col: str = "pos", seed: int = 42,
            n_folds: int = 5) -> dict:
    """Concatenate both sides (train first), report conflicts, group-split."""
    both = _sides(train, dev)
    both = both.withColumn("__ord", F.struct("__side", pos_col))
    conflicts = audit.conflicts(both)
    parts = split.group_split(both, "text", "label", "__ord", seed=seed, n_folds=n_folds)
    return {"conflicts": conflicts, "split": parts, "leaked_groups": split.leaked_groups(parts)}
