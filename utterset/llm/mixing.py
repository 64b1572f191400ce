"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Whole copies of the source are taken as
often as they fit (at most twice); for the remaining budget, documents are counted by
exact length, each length gives its proportional part, and a bounded-knapsack
dynamic programme over (length, documents left) fills what is left to the word if any
choice does. Which documents of a length are taken follows a seeded hash.

Edge cases: a null or blank text has size 0 and takes 0 words; null is a source of its
own, in last place; an empty table stays empty; repeated rows (of one ``doc_id``) are
documents of their own; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored, without

#: Words of the remaining budget up to which the dynamic programme runs (a bit each).
EXACT_WORDS = 1 << 16
#: (source, length) rows that may be broadcast.
BROADCAST_LENGTHS = 1 << 18
#: Documents of one source and length in a bucket of the seeded order.
BUCKET = 64
MAX_BUCKETS = 4096


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words of each source: by weight ``share`` of all words, none above ``most`` times
    its own; what is above is shared again by weight until none is above."""
    out, left, budget = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while left:
        each = budget / sum(weights[i] for i in left)
        full = [i for i in left if weights[i] * each >= most * sizes[i]]
        if not full:
            for i in left:
                out[i] = weights[i] * each
            break
        for i in full:
            out[i] = most * sizes[i]
            budget -= out[i]
        left = [i for i in left if i not in set(full)]
    return out


def subset_sum(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take for the largest sum up to ``budget``."""
    taken = [0] * len(sizes)
    reached, mask = 1, (1 << (budget + 1)) - 1
    via, items = np.full(budget + 1, -1, np.int64), []
    for i, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        part = 1
        while count > 0 and part * size <= budget and not reached >> budget & 1:
            n = min(part, count)
            count, part = count - n, part * 2
            fresh = (reached << n * size) & mask & ~reached
            if fresh:
                bits = np.frombuffer(fresh.to_bytes((budget + 8) // 8, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = len(items)
                reached |= fresh
            items.append((i, n))
    at = reached.bit_length() - 1
    while at:
        i, n = items[via[at]]
        taken[i] += n
        at -= n * sizes[i]
    return taken


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, budget: int, exact_words: int = EXACT_WORDS) -> np.ndarray:
    """Documents to take of each length: proportionally, then one more of some lengths,
    then the exact programme for the last ``exact_words``."""
    total = int((sizes * counts).sum())
    taken = np.array([int(c) * budget // max(total, 1) for c in counts], np.int64)
    left = budget - int((taken * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    moved = True
    while left > exact_words and moved:
        moved = False
        for i in order:
            if left > exact_words and taken[i] < counts[i] and 0 < sizes[i] <= left:
                n = min(int(counts[i] - taken[i]), max(1, left // (4 * int(sizes[i]))))
                taken[i] += n
                left -= n * int(sizes[i])
                moved = True
    some = [i for i in order if 0 < sizes[i] <= left and taken[i] < counts[i]]
    for i, n in zip(some, subset_sum([int(sizes[i]) for i in some], [int(counts[i] - taken[i]) for i in some], left), strict=True):
        taken[i] += n
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``:
    how often the mix takes the document)."""
    if most not in (1, 2):
        raise ValueError("most must be 1 or 2")
    docs = without(docs, "size", "source_size", "target", "copies")
    # The source as JSON: null groups and joins like any other value. Names of our own
    # begin with "__" lest they clash with the input's columns.
    own = docs.withColumns({"size": word_count(), "__s": F.to_json(F.struct("source")), "__h": F.xxhash64(F.lit(seed), F.col("doc_id"))})
    slim = stored(own.select("__s", "source", "size", "__h"), "sizes")
    lengths = stored(slim.groupBy("__s", "size").agg(F.count(F.lit(1)).alias("__n"), F.min("source").alias("__source")), "lengths")

    # A row for each source, whatever the number of documents.
    rows = lengths.groupBy("__s").agg(F.sum(F.col("size") * F.col("__n")).alias("words"), F.min("__source").alias("source")) \
        .orderBy(F.col("source").isNull(), "source").collect()
    share_of = targets([r["words"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    goal = docs.sparkSession.createDataFrame([(r["__s"], r["words"], float(t)) for r, t in zip(rows, share_of, strict=True)],
                                             "__s string, source_size long, target double")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        words, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        whole = min(most, int(target / words + 1e-12)) if words else 0
        frame = frame.sort_values("size", kind="stable").reset_index(drop=True)
        extra = fit_lengths(frame["size"].to_numpy(), frame["__n"].to_numpy(), round(target) - whole * words) if whole < most else 0
        return frame.assign(__whole=whole, __extra=extra)

    # A source's group has a row for each length.
    plan = lengths.drop("__source").join(F.broadcast(goal), "__s").groupBy("__s").applyInPandas(
        fit, "__s string, size long, __n long, source_size long, target double, __whole int, __extra long")
    plan = stored(plan.withColumn("__buckets", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("__n") / BUCKET)).cast("int")), "plan")
    small = plan.count() <= BROADCAST_LENGTHS

    def bucketed(df, lengths_of):
        place = F.floor(F.shiftrightunsigned("__h", 16) / F.lit(float(1 << 48)) * F.col("__buckets")).cast("int")
        return df.join(F.broadcast(lengths_of) if small else lengths_of, ["__s", "size"]).withColumn("__bucket", place)

    counted = bucketed(slim, plan.filter("__extra > 0").select("__s", "size", "__buckets", "__extra")) \
        .groupBy("__s", "size", "__extra", "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("__s", "size").orderBy("__bucket"))
    before = F.col("upto") - F.col("__c")
    cut = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("__extra")) & (before < F.col("__extra"))) \
        .select("__s", "size", F.col("__bucket").alias("__cut"), (F.col("__extra") - before).alias("__need"))
    plan = stored(plan.join(cut, ["__s", "size"], "left"), "cuts")

    rows = bucketed(own, plan.drop("__n", "__extra"))
    decided = rows.filter("__cut is null or __bucket <> __cut").withColumn(
        "copies", F.col("__whole") + F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(False)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("__s", "size").orderBy("__h", "doc_id"))
    ranked = rows.filter("__bucket = __cut").withColumn("copies", F.col("__whole") + (rank <= F.col("__need")).cast("int"))
    return decided.unionByName(ranked).select(*docs.columns, "size", "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them."""
    out = mix(docs, **options).filter("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
