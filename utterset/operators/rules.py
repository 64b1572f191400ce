"""Keyword-rule classifier (ML-3 / JN-8) with portable, hash-drawn probabilities.

Semantics (first rule wins, substring match on lower-cased text): the rule with
the smallest ``priority`` whose any keyword occurs in the text gives the label.
No match -> a label drawn by hash from the label list (or a fixed label).

Probabilities: the winner gets a raw score in [0.7000, 0.9500], every other
label one in [0.0100, 0.1/(L-1)], all in units of 1e-4 and drawn by hash of
(seed, text, label index); each is then divided by the total and rounded to 4
places with integer arithmetic (half-up), so Spark and DuckDB agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_u32
from .dictionary import match_dictionary

# The reference's keyword rules, in rule order (priority 1 first).
REFERENCE_RULES = [
    (1, ["会议室", "预订", "订", "会议"], "BOOK_MEETING_ROOM"),
    (2, ["工资", "工资单", "薪资", "薪水"], "CHECK_PAYSLIP"),
    (3, ["请假", "休假", "假期"], "REQUEST_LEAVE"),
    (4, ["福利", "保险", "公积金"], "CHECK_BENEFITS"),
    (5, ["电脑", "系统", "IT", "技术", "故障"], "IT_TICKET"),
    (6, ["报销", "费用", "发票"], "EXPENSE_REIMBURSE"),
    (7, ["负责人", "领导", "决策人", "管理者", "老板", "一把手", "主管", "牵头人"], "QUERY_RESPONSIBLE_PERSON"),
]

# The nine-label list of the training script and the API fallback.
REFERENCE_LABELS = ["CHECK_PAYSLIP", "BOOK_MEETING_ROOM", "REQUEST_LEAVE",
                    "CHECK_BENEFITS", "IT_TICKET", "EXPENSE_REIMBURSE", "COMPANY_LOOKUP",
                    "USER_LOOKUP", "QUERY_RESPONSIBLE_PERSON"]

#: Rules that may go through the driver and as a broadcast to the tasks, and what a rule
#: takes beside its strings.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 200
WIN_LO, WIN_HI = 7000, 9500      # winner raw score, units of 1e-4
OTHER_LO = 100                   # 0.01


def rules_frame(spark: SparkSession, rules=REFERENCE_RULES) -> DataFrame:
    """``rules(priority INT, keyword STRING, label STRING)`` from a Python list."""
    rows = [(p, k, lab) for p, kws, lab in rules for k in kws]
    return spark.createDataFrame(rows, "priority INT, keyword STRING, label STRING")


def other_range(n_labels: int) -> tuple[int, int]:
    """Raw-score range of a non-winning label, units of 1e-4 (both ends inclusive)."""
    base = int(0.1 / (n_labels - 1) * 10000) if n_labels > 1 else OTHER_LO
    return min(OTHER_LO, base), max(OTHER_LO, base)


def rules_bytes(rules_df: DataFrame) -> int:
    """About the bytes that the rule table takes as Python objects."""
    size = F.length("keyword") + F.length("label") + ROW_BYTES
    return rules_df.agg(F.sum(size.cast("long"))).first()[0] or 0


def _ranked_rules(rules_df: DataFrame, lower_keywords: bool) -> tuple[list[str], dict[str, int]]:
    """Labels in rule order and, for each keyword, the place of its first rule. For rule
    tables below ``BROADCAST_BYTES`` only: they go to the driver and from there to the tasks."""
    rows = sorted({(r["priority"], r["label"], r["keyword"].lower() if lower_keywords else r["keyword"])
                   for r in rules_df.select("priority", "label", "keyword").collect()
                   if r["keyword"] is not None})
    first: dict[str, int] = {}
    for place, (_, _, keyword) in enumerate(rows):
        first.setdefault(keyword, place)
    return [label for _, label, _ in rows], first


def match_rules(df: DataFrame, rules_df: DataFrame, text_col: str = "text",
                lower_keywords: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``rule_label`` (null when no rule matches, or the text is null).

    Up to ``broadcast_bytes`` of rules, an automaton of all keywords passes over each
    lower-cased text once, inside the scan's partitions, without a join or shuffle.
    Larger rule tables stay tables (``dictionary.match_dictionary``).
    An empty keyword matches every text."""
    if rules_bytes(rules_df) > broadcast_bytes:
        return match_dictionary(df, rules_df, text_col, lower_keywords)
    labels, first = _ranked_rules(rules_df, lower_keywords)
    held = df.sparkSession.sparkContext.broadcast((labels, first))

    def label_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        labels, first = held.value
        words = ahocorasick.Automaton()
        for keyword, place in first.items():
            if keyword:
                words.add_word(keyword, place)
        words.make_automaton()
        always = first.get("", len(labels))

        def best(text):
            if text is None:
                return None
            place = min((p for _, p in words.iter(text)), default=always) if len(words) else always
            place = min(place, always)
            return labels[place] if place < len(labels) else None

        for texts in batches:
            yield texts.map(best)

    udf = F.pandas_udf(label_of, "string")
    return df.withColumn("rule_label", udf(F.lower(F.col(text_col))))


def score_rules(df: DataFrame, rules_df: DataFrame, labels: list[str], text_col: str = "text",
                seed: int = 42, no_match: str | None = None, lower_keywords: bool = True,
                with_probs: bool = True) -> DataFrame:
    """ML-3: ``intent``, ``confidence`` and (optionally) ``probs MAP<label, prob>``.

    ``no_match=None`` draws the label by hash (the reference draws at random);
    a string fixes it (for example ``'OTHER'``, which must then be in ``labels``).
    """
    n = len(labels)
    lo, hi = other_range(n)
    lab_arr = F.array(*[F.lit(x) for x in labels])
    h = F.sha1(F.col(text_col).cast("string"))
    matched = match_rules(df, rules_df, text_col, lower_keywords)
    fallback = F.element_at(lab_arr, (F.pmod(hash_u32(seed, h, F.lit("fallback")), F.lit(n)) + 1).cast("int")) \
        if no_match is None else F.lit(no_match)
    out = matched.withColumn("intent", F.coalesce(F.col("rule_label"), fallback)).drop("rule_label")
    idx = F.sequence(F.lit(0), F.lit(n - 1))

    def raw(i):
        lab = F.element_at(lab_arr, i + 1)
        win = F.lit(WIN_LO) + F.pmod(hash_u32(seed, h, F.concat(F.lit("p"), i.cast("string"))),
                                     F.lit(WIN_HI - WIN_LO + 1))
        oth = F.lit(lo) + F.pmod(hash_u32(seed, h, F.concat(F.lit("p"), i.cast("string"))),
                                 F.lit(hi - lo + 1))
        return F.when(lab == F.col("intent"), win).otherwise(oth)

    out = out.withColumn("__raw", F.transform(idx, raw))
    total = F.aggregate(F.col("__raw"), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("__tot", total)
    probs = F.transform(F.col("__raw"),
                        lambda x: F.floor((x * 20000 + F.col("__tot")) / (F.col("__tot") * 2)) / 10000.0)
    out = out.withColumn("__p", probs)
    pos = F.array_position(lab_arr, F.col("intent")).cast("int")
    out = out.withColumn("confidence", F.element_at(F.col("__p"), pos))
    if with_probs:
        out = out.withColumn("probs", F.map_from_arrays(lab_arr, F.col("__p")))
    return out.drop("__raw", "__tot", "__p")
