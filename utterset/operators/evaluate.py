"""Classification metrics from (truth, prediction) pairs (EV-1..EV-6).

Everything starts from one aggregate -- the confusion counts
``groupBy(y, pred).count()`` -- whose size is bounded by classes^2, so the
per-class arithmetic runs on a tiny table. Classes are truth U prediction
(the library default) unless a class table is given; a class with no rows then
reports zeros instead of failing. Division by zero gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_LIMIT = 10_000


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """EV-1: one row ``(n, accuracy)``."""
    same = F.col("y") == F.col("pred")
    return confusion_counts(df, y, pred).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        (F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum(F.when(same.isNotNull(), F.col("n")))).alias("accuracy"))


def _classes(conf: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is not None:
        return classes.select(F.col(classes.columns[0]).alias("label")).distinct()
    return conf.select(F.col("y").alias("label")).union(conf.select(F.col("pred").alias("label"))).distinct()


def per_class(df: DataFrame, y: str = "y", pred: str = "pred", classes: DataFrame | None = None) -> DataFrame:
    """``(label, tp, fp, fn, support, precision, recall, f1)`` per class.

    Each confusion count goes once to its true and once to its predicted class, so
    ``df`` is read once."""
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("y") == F.col("pred"), n).otherwise(zero)
    sides = F.array(F.struct(F.col("y").alias("label"), n.alias("support"), hit.alias("tp"), zero.alias("n_pred")),
                    F.struct(F.col("pred").alias("label"), zero.alias("support"), zero.alias("tp"), n.alias("n_pred")))
    sums = ["support", "tp", "n_pred"]
    t = confusion_counts(df, y, pred).select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in sums])
    if classes is not None:
        wanted = classes.select(F.col(classes.columns[0]).alias("label")).distinct()
        t = wanted.join(t, "label", "left").fillna(0, sums)
    tp, sup, npred = F.col("tp"), F.col("support"), F.col("n_pred")
    fp, fn = npred - tp, sup - tp
    return t.select(
        "label", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"),
        sup.cast("long").alias("support"),
        F.when(npred > 0, tp / npred).otherwise(0.0).alias("precision"),
        F.when(sup > 0, tp / sup).otherwise(0.0).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def macro_scores(df: DataFrame, y: str = "y", pred: str = "pred", classes: DataFrame | None = None,
                 digits: int = 6) -> DataFrame:
    """EV-1 + EV-2: accuracy and macro precision / recall / F1 (rounded)."""
    pc = per_class(df, y, pred, classes)
    macro = pc.agg(F.round(F.avg("precision"), digits).alias("precision"),
                   F.round(F.avg("recall"), digits).alias("recall"),
                   F.round(F.avg("f1"), digits).alias("f1"))
    acc = accuracy(df, y, pred).select(F.round("accuracy", digits).alias("accuracy"), "n")
    return _one_row_concat(acc, macro)


def _one_row_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two single-row frames side by side (planned as a nested loop of one row by one)."""
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def report(df: DataFrame, y: str = "y", pred: str = "pred", classes: DataFrame | None = None,
           digits: int = 4) -> DataFrame:
    """EV-3: per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    pc = per_class(df, y, pred, classes)
    rows = pc.select(F.col("label").alias("row"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"), total.alias("support"))
    acc = accuracy(df, y, pred).select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                                       F.lit(None).cast("double").alias("recall"),
                                       F.col("accuracy").alias("f1"), F.col("n").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion_long(df: DataFrame, y: str = "y", pred: str = "pred", classes: DataFrame | None = None) -> DataFrame:
    """EV-4 (long form): every (true, predicted) class pair with its count, zero-filled.

    The class list is bounded (checked) and expanded with ``explode`` of a
    literal array, so no cross join is planned.
    """
    conf = confusion_counts(df, y, pred)
    labels = [r["label"] for r in _classes(conf, classes).limit(CLASS_LIMIT + 1).collect()]
    if len(labels) > CLASS_LIMIT:
        raise ValueError("too many classes for a dense confusion matrix")
    lit_arr = F.array(*[F.lit(x) for x in sorted(labels)])
    pairs = conf.sparkSession.range(1).select(F.explode(lit_arr).alias("y")) \
        .select("y", F.explode(lit_arr).alias("pred"))
    return pairs.join(conf, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(df: DataFrame, y: str = "y", pred: str = "pred", labels: list[str] | None = None) -> DataFrame:
    """EV-4 (wide form): one row per true class, one column per predicted class."""
    conf = confusion_counts(df, y, pred)
    g = conf.groupBy("y")
    return (g.pivot("pred", labels) if labels is not None else g.pivot("pred")).sum("n").fillna(0)


def exact_mean(value: Column) -> Column:
    """Mean at six places (half up) of values with at most nine decimals, as an aggregate:
    the same in any order of the rows and on any engine, as all sums are of whole numbers."""
    total = F.sum(value.cast("decimal(18,9)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)")
    n = F.count(value).cast("decimal(19,0)")
    half_up = F.call_function("div", total * 2 + n * 1000, n * 2000)
    return F.when(F.count(value) > 0, half_up / F.lit(10.0**6))


def confidence_by_label(df: DataFrame, label: str = "pred", conf: str = "confidence",
                        threshold: float = 0.5) -> DataFrame:
    """EV-5: rows, mean confidence and low-confidence share per label."""
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        exact_mean(F.col(conf)).alias("mean_confidence"),
        F.round(F.avg((F.col(conf) < threshold).cast("int")), 6).alias("low_share"))


def top_confusions(df: DataFrame, y: str = "y", pred: str = "pred", k: int = 5) -> DataFrame:
    """EV-6: the k most frequent (true, predicted) pairs with true != predicted."""
    conf = confusion_counts(df, y, pred)
    return conf.filter(F.col("y") != F.col("pred")).orderBy(F.desc("n"), "y", "pred").limit(k)
