"""Synthetic utterance generation from templates (GE-1..GE-3, FL-5).

The job is narrow: ``spark.range(labels * n)`` and one column expression. Each
row's template and slot values are hash draws of (seed, label, sample number,
slot), so generation needs no shuffle, no driver loop and no random state, and
any engine with md5 reproduces the exact text.

Sample ``i`` of a label with G > 1 template groups (the grouped look-up label)
uses group ``i // per_group`` while ``i < G * per_group`` with
``per_group = max(1, n // G)``, and a drawn group for the remainder -- the
reference's "even share per group, rest at random, cut to n" rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_u32
from ..functions.templates import LABEL_ORDER, TEMPLATE_SETS


def validate_labels(requested, available) -> list[str]:
    """FL-5: reject unknown label names, listing them and the valid ones."""
    bad = [x for x in requested if x not in available]
    if bad:
        raise ValueError(f"Invalid label(s): {bad}. Valid labels are: {list(available)}")
    return list(requested)


def _pick(arr: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in arr]), (idx + 1).cast("int"))


def _fill(seed, label: Column, i: Column, templates: list[str], vocab: dict) -> Column:
    t = F.pmod(hash_u32(seed, label, i, F.lit("template")), F.lit(len(templates)))
    text = _pick(templates, t)
    for slot, values in vocab.items():
        v = _pick(values, F.pmod(hash_u32(seed, label, i, F.lit("slot:" + slot)), F.lit(len(values))))
        text = F.replace(text, F.lit("{" + slot + "}"), v)
    return text


def group_of(seed, label: Column, i: Column, n: int, n_groups: int) -> Column:
    if n_groups == 1:
        return F.lit(0).cast("long")
    per_group = max(1, n // n_groups)
    drawn = F.pmod(hash_u32(seed, label, i, F.lit("group")), F.lit(n_groups))
    return F.when(i < F.lit(n_groups * per_group), F.floor(i / F.lit(per_group))).otherwise(drawn).cast("long")


def generate(spark: SparkSession, n_per_label: int, labels=None, seed: int = 42,
             sets: dict | None = None) -> DataFrame:
    """GE-3: ``(label, sample_idx, grp, text)`` -- ``n_per_label`` rows per label."""
    sets = TEMPLATE_SETS if sets is None else sets
    order = [x for x in LABEL_ORDER if x in sets] + [x for x in sets if x not in LABEL_ORDER]
    labels = order if labels is None else validate_labels(labels, order)
    n = int(n_per_label)
    ids = spark.range(0, len(labels) * n)
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.floor(F.col("id") / n) + 1).cast("int"))
    df = ids.select(lab.alias("label"), F.pmod(F.col("id"), F.lit(n)).alias("sample_idx"))
    grp = None
    for name in labels:
        g = group_of(seed, F.col("label"), F.col("sample_idx"), n, len(sets[name]))
        grp = F.when(F.col("label") == name, g) if grp is None else grp.when(F.col("label") == name, g)
    df = df.withColumn("grp", grp)
    text = None
    for name in labels:
        for g, (tmpls, vocab) in enumerate(sets[name]):
            cond = (F.col("label") == name) & (F.col("grp") == g)
            arm = _fill(seed, F.col("label"), F.col("sample_idx"), tmpls, vocab)
            text = F.when(cond, arm) if text is None else text.when(cond, arm)
    return df.withColumn("text", text)
