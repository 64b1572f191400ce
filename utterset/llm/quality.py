"""Quality rules with risk-controlled thresholds.

Each rule compares a measure of the text with a cutoff from a fixed grid, from loose to
tight. The loss of a good document is 1 if any rule rejects it, so that the rules share
one risk, and one document that several rules reject counts once.

For each stratum (language), a quarter of its labelled documents, by a hash of the id,
chooses a path: all steps "rule r to its next cutoff", in the order of the good documents of
this part that the cutoff rejects (then of the bad ones that it doesn't). The rest tests
the path: after each step the null hypothesis "more than ``risk`` of the good documents
are rejected by the rules so far" is tested with the exact binomial tail at the level
``error`` / strata, and the last step before the first failure stays. The path is fixed
before the test sees its part, so going down it costs no correction; strata are corrected
by Bonferroni. So with probability 1 - ``error`` no stratum loses more than ``risk`` of its
good documents to the rules. A rule without a certified cutoff is not used in the stratum;
``certified`` says which these are.

Edge cases: a null or blank text has no words and fails the base rule; a null language
is a stratum of its own; documents without labels are only judged; a document with
several label rows counts with each; without labels no rule is used; repeated rows are
judged alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored, widened, without
from .wordops import Words, hash_strings, mix, slices, split_words, windows

REPEAT = 8
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
            "n_lines": "long", "n_upper": "long"}
#: Rule: (measure, cutoffs from loose to tight); a text whose measure is above the cutoff is rejected.
RATIOS = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)
RULES = {
    "symbols": ("n_symbols / word_chars", RATIOS),
    "dup_lines": ("n_dup_lines / n_lines", RATIOS),
    "repeats": ("n_repeat_words / n_words", RATIOS),
    "upper": ("n_upper / word_chars", RATIOS),
    "word_length": ("word_chars / n_words", (60, 40, 30, 25, 20, 18, 16, 14, 12, 11, 10, 9, 8)),
}
RISK, ERROR = 0.02, 0.05
#: One in so many labelled documents chooses the path, the others test it.
CHOOSING = 4
BLANK = " \t\n\x0b\x0c\r"


def repeated_words(words: Words) -> np.ndarray:
    """For each text the words that stand in a window of 8 words found twice or more in it."""
    flat, starts = windows(words, REPEAT)
    n_texts = len(words.offsets) - 1
    if not len(flat):
        return np.zeros(n_texts, np.int64)
    text = np.repeat(np.arange(n_texts), np.diff(starts))
    _, inverse, count = np.unique(mix(flat + mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    first = words.offsets[text[twice]] + twice - starts[text[twice]]
    edge = np.bincount(first, minlength=len(words.hashes) + 1) - np.bincount(first + REPEAT, minlength=len(words.hashes) + 1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    return np.diff(covered[words.offsets])


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` but with the measures of the whole text."""
    docs = without(docs, *MEASURES)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "")
                words, offsets = split_words(texts)
                chars = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))))[offsets]
                lines = [[x for x in t.split("\n") if x.strip(BLANK)] for t in texts.to_pylist()]
                values = [np.diff(offsets), np.diff(chars), pc.count_substring_regex(texts, r"[#*$%&|<>]"),
                          [len(x) - len(set(x)) for x in lines], repeated_words(Words(hash_strings(words), offsets)),
                          [len(x) for x in lines], pc.count_substring_regex(texts, "[A-Z]")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(v).cast(pa.int64()) for v in values)],
                                                 names=[*names, *MEASURES])

    return docs.mapInArrow(run, widened(docs.drop("text"), **MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    x = np.arange(k + 1)
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in x.tolist()]
    top = max(terms)
    return min(1.0, exp(top) * float(np.exp(np.array(terms) - top).sum()))


def _ratio(rule: str) -> Column:
    top, below = RULES[rule][0].split(" / ")
    return F.expr(f"coalesce(try_divide({top}, {below}), 0)")


def _first(rule: str) -> Column:
    """The loosest of the rule's cutoffs (by number) that rejects the text, or their number."""
    return sum(((_ratio(rule) <= c).cast("int") for c in RULES[rule][1]), F.lit(0))


def choose_path(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[tuple[str, int]]:
    """All steps (rule, number of its cutoff), by the good documents that the cutoff rejects,
    then by the bad ones it doesn't; a rule's cutoffs stay in their order."""
    steps = [(g, -bad[rule][i], i, rule) for rule, counts in good.items() for i, g in enumerate(counts)]
    path: list[tuple[str, int]] = []
    for _, _, i, rule in sorted(steps):
        path += [(rule, k) for k in range(i + 1) if (rule, k) not in path]
    return path


def certified_steps(rejected: list[int], n: int, risk: float, level: float) -> int:
    """How many steps of a path pass: ``rejected`` has the good documents rejected after each."""
    for k, x in enumerate(rejected):
        if n == 0 or binomial_tail(x, n, risk) > level:
            return k
    return len(rejected)


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str | None, dict[str, float]]:
    """Certified cutoffs per stratum from rows (``doc_id``, ``stratum``, ``quality``, measures)."""
    rules = list(RULES)
    rows = labelled.filter("quality in (0, 1)").select("stratum", "quality", (F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(CHOOSING)) == 0).alias("chooses"),
                                                       *[_first(r).alias(r) for r in rules])
    # One row a stratum, with a count for each rule and cutoff.
    counts = [F.sum(((F.col("quality") == q) & F.col("chooses") & (F.col(r) <= i)).cast("long")).alias(f"{r}_{q}_{i}")
              for r in rules for q in (0, 1) for i in range(len(RULES[r][1]))]
    held = stored(rows, "quality-steps")
    paths = {}
    for row in held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts).collect():
        by = [{r: [row[f"{r}_{q}_{i}"] for i in range(len(RULES[r][1]))] for r in rules} for q in (0, 1)]
        paths[row["stratum"]] = choose_path(by[1], by[0])
    if not paths:
        return {}
    # The step of its stratum's path at which a tested good document is rejected first.
    steps = [(name, [[path.index((r, i)) for i in range(len(RULES[r][1]))] for r in rules]) for name, path in paths.items()]
    table = labelled.sparkSession.createDataFrame(steps, widened(labelled.select("stratum"), steps="array<array<int>>"))
    good = held.filter("quality = 1 and not chooses").withColumnRenamed("stratum", "own").join(F.broadcast(table), F.col("own").eqNullSafe(F.col("stratum")))
    first = [F.get(F.get(F.col("steps"), F.lit(k)), F.col(r)) for k, r in enumerate(rules)]  # null: the rule never rejects it
    by_step = good.groupBy("stratum", F.least(*first).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # the path's steps at most
    out: dict[str | None, dict[str, float]] = {}
    for name, path in paths.items():
        found = {r["step"]: r["n"] for r in by_step if r["stratum"] == name}
        rejected = np.cumsum([found.get(k, 0) for k in range(len(path))]).tolist()
        for rule, i in path[:certified_steps(rejected, sum(found.values()), risk, error / len(paths))]:
            out.setdefault(name, {})[rule] = float(RULES[rule][1][i])
    return out


def certified(bounds: dict[str | None, dict[str, float]], strata: list[str | None]) -> dict[str | None, dict[str, float | None]]:
    """For each stratum the cutoff of every rule, None where it is not certified."""
    return {s: {rule: bounds.get(s, {}).get(rule) for rule in RULES} for s in strata}


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``docs`` without ``text``, with the measures, ``base_failed``, ``failed_rules``
    (names) and ``kept``. labels: (doc_id, quality), quality 1 is good."""
    docs = without(docs, *MEASURES, "base_failed", "failed_rules", "kept", "__quality", "__key", "__bounds")
    measured = stored(measure(docs).withColumn("base_failed", base_failed()), "measures")
    marks = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("__quality"))
    sample = measured.filter("not base_failed").join(marks, F.col("doc_id") == F.col("labelled_id"))
    bounds = cutoffs(sample.select("doc_id", F.col(stratum).alias("stratum"), F.col("__quality").alias("quality"), *MEASURES), risk, error)
    rows = [(stratum_ is None, stratum_ or "", rule, c) for stratum_, rules in bounds.items() for rule, c in rules.items()]
    table = docs.sparkSession.createDataFrame(rows, "none boolean, name string, rule string, cutoff double") \
        .groupBy(F.struct("none", "name").alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__bounds"))
    key = F.struct(F.col(stratum).isNull().alias("none"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("name"))
    judged = measured.withColumn("__key", key).join(table, "__key", "left")
    failed = F.filter(F.array(*[F.when(_ratio(rule) > F.col("__bounds")[rule], F.lit(rule)) for rule in RULES]), lambda x: x.isNotNull())
    return judged.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)) \
        .drop("__key", "__bounds")
