"""Prompt construction for labelling and label-space induction (PX-8..PX-12, WN-5).

Token counts use the ``max(1, ceil(len/4))`` estimate (PX-9), which makes every
"largest prefix that fits" question a closed form or a running sum, so the
reference's quadratic re-counting loops become one window or one array fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_key
from ..functions.tokens import TokenCounter
from ..functions.text import json_quote, split_lines, text_prefix, token_estimate, trim_to_tokens

# The labelling prompt (system part and user template, after
# Python's str.format has turned doubled braces into single ones).
LABEL_SYS_PROMPT = "你是意图识别标注助手。请仅根据“标签空间定义”与“问题文本”选择单一最合适的标签，并给出置信度。务必输出严格JSON。"
LABEL_USER_HEAD = "标签空间定义（精简JSON）：\n"
LABEL_USER_MID = "\n\n问题文本：\n\""
LABEL_USER_TAIL = ("\"\n\n仅输出如下JSON：\n{\n  \"label_id\": \"与标签空间中的 id 完全一致\",\n"
                   "  \"label_name\": \"对应中文名\",\n  \"confidence\": 0.0~1.0 之间的小数（保留三位）\n}\n")

# The label-space induction prompt; "{max_labels}" and the sample
# slot "{SAMPLES}" are filled in here.
SCHEMA_SYS_PROMPT = "你是企业AI问答系统的“意图标签集设计专家”。目标：用尽量少且清晰的标签覆盖问题类型，便于后续训练意图识别。"
SCHEMA_USER_TMPL = (
    "请基于以下真实用户问题样本，设计一个“意图标签空间”：\n"
    "- 标签数量上限：{max_labels}\n"
    "- 要求互斥、清晰、可操作，避免过细颗粒\n"
    "- 允许保留一个“OTHER/无法归类”兜底类\n"
    "- 产出严格JSON，结构如下：\n"
    "{\n"
    "  \"labels\": [\n"
    "    {\n"
    "      \"id\": \"UPPER_SNAKE_CASE_ID\",\n"
    "      \"name\": \"中文名称简洁\",\n"
    "      \"description\": \"一句话说明边界与示例\",\n"
    "      \"keywords\": [\"可选：若干识别关键词\"]\n"
    "    }\n"
    "  ],\n"
    "  \"rationale\": \"你如何划分的简述（50字内）\"\n"
    "}\n"
    "\n"
    "以下是样本（去重后，已自动截断至上下文上限内）：\n"
    "{SAMPLES}\n"
)
SAMPLE_MARKER = "以下是样本"
SAMPLES_SLOT = "{SAMPLES}"
OVERHEAD_TOKENS = 20
LABEL_LIMIT = 10_000


def py_token_estimate(s: str) -> int:
    return max(1, -(-len(s) // 4))


def compact_label_space(label_space: DataFrame, order_col: str = "label_pos", per_desc_limit: int = 180,
                        max_json_chars: int = 4000) -> str:
    """PX-8: ``{"labels": [{"id", "name", "description"}, ...]}`` as Python's
    ``json.dumps(ensure_ascii=False)`` writes it; descriptions are cut to 60
    characters when the whole text is longer than ``max_json_chars``.

    The label space is one row per label (tens of rows); the result is one
    string, returned to the driver so it can be a literal in prompts. More than
    ``LABEL_LIMIT`` labels, far beyond what any prompt holds, fail before they are gathered.
    """
    if label_space.limit(LABEL_LIMIT + 1).count() > LABEL_LIMIT:
        raise ValueError(f"a label space of more than {LABEL_LIMIT} labels fits no prompt")

    def rendered(limit: int) -> Column:
        item = F.concat(F.lit('{"id": '), json_quote(F.substring(F.upper(F.col("id").cast("string")), 1, 80)),
                        F.lit(', "name": '), json_quote(F.substring(F.col("name").cast("string"), 1, 80)),
                        F.lit(', "description": '),
                        json_quote(F.substring(F.coalesce(F.col("description"), F.lit("")), 1, limit)),
                        F.lit("}"))
        items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), item.alias("j"))))
        return F.concat(F.lit('{"labels": ['), F.array_join(F.transform(items, lambda x: x["j"]), ", "), F.lit("]}"))

    row = label_space.agg(rendered(per_desc_limit).alias("a"), rendered(min(60, per_desc_limit)).alias("b")).first()
    return row["a"] if len(row["a"]) <= max_json_chars else row["b"]


def labelling_prompt(text_col, label_json: str) -> Column:
    """PX-12: the per-text labelling prompt."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.concat(F.lit(LABEL_USER_HEAD + label_json + LABEL_USER_MID), t, F.lit(LABEL_USER_TAIL))


def with_prompts(df: DataFrame, label_json: str, text_col: str = "text") -> DataFrame:
    """PX-12 + PX-13: add ``prompt`` and the content key ``cache_key``."""
    return df.withColumn("prompt", labelling_prompt(text_col, label_json)) \
        .withColumn("cache_key", content_key(F.col(text_col), label_json))


def pack_samples(questions: DataFrame, order_col: str = "src_pos", text_col: str = "text",
                 group_cols=(), max_samples: int = 400, max_labels: int = 25,
                 max_context_tokens: int = 8192, output_reserve_tokens: int = 1024,
                 line_chars: int = 300) -> DataFrame:
    """SO-2 + PX-6 + WN-5: one label-space prompt per group.

    Takes the first ``max_samples`` questions (0 = all) by ``order_col``, each
    as a line ``- <first 300 chars>``, and keeps the longest leading run of
    lines for which the prompt still fits the token budget. The fit test is
    monotone in the number of lines, so the reference's add-until-it-breaks
    loop equals a filter on a running length sum.
    """
    groups = list(group_cols)
    tmpl = SCHEMA_USER_TMPL.replace("{max_labels}", str(max_labels))
    budget = max_context_tokens - output_reserve_tokens
    fixed_len = len(tmpl) - len(SAMPLES_SLOT)
    sys_tokens = py_token_estimate(SCHEMA_SYS_PROMPT)
    # No line beyond this count can fit: every line costs at least 4 characters
    # ("- x" and its newline). Bounding first keeps the window below small.
    limit_chars = (budget - sys_tokens - OVERHEAD_TOKENS) * 4
    cap = max(0, (limit_chars - fixed_len) // 4 + 1)
    k_max = min(max_samples, cap) if max_samples else cap
    lines = questions.select(*groups, F.col(order_col).alias("__o"),
                             F.concat(F.lit("- "), text_prefix(text_col, line_chars)).alias("line"))
    if groups:
        w = Window.partitionBy(*groups).orderBy("__o")
        lines = lines.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k_max)
    else:
        # global first-N: a bounded top-k (TakeOrderedAndProject), then a window over <= k_max rows
        w = Window.partitionBy(F.lit(0)).orderBy("__o")
        lines = lines.orderBy("__o").limit(k_max).withColumn("__k", F.row_number().over(w))
    run = F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("__len", F.lit(fixed_len) + run + F.col("__k") - 1)
    fits = F.lit(sys_tokens) + F.greatest(F.lit(1), F.ceil(F.col("__len") / 4)) + OVERHEAD_TOKENS <= budget
    kept = lines.filter(fits)
    packed = kept.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "line"))), lambda x: x["line"]),
                     "\n").alias("__samples"))
    head, tail = tmpl.split(SAMPLES_SLOT)
    prompt = F.concat(F.lit(head), F.col("__samples"), F.lit(tail))
    return packed.select(*groups, "n_lines", prompt.alias("prompt"))


def pack_samples_exact(questions: DataFrame, counter: TokenCounter, order_col: str = "src_pos", text_col: str = "text",
                       group_cols=(), max_samples: int = 400, max_labels: int = 25,
                       max_context_tokens: int = 8192, output_reserve_tokens: int = 1024,
                       line_chars: int = 300) -> DataFrame:
    """``pack_samples`` with the exact tokens of ``counter`` instead of the estimate.

    Every line has a token of its own (its dash), so a group's prompt holds fewer lines
    than the budget has tokens; only so many, and ``max_samples`` at most, meet in a row.
    Null texts are left out."""
    groups = list(group_cols)
    head, tail = SCHEMA_USER_TMPL.replace("{max_labels}", str(max_labels)).split(SAMPLES_SLOT)
    most = max_context_tokens - output_reserve_tokens
    k_max = min(max_samples, most) if max_samples else most
    lines = questions.filter(F.col(text_col).isNotNull()).select(
        *groups, F.col(order_col).alias("__o"), F.concat(F.lit("- "), text_prefix(text_col, line_chars)).alias("line"))
    if groups:
        place = F.row_number().over(Window.partitionBy(*groups).orderBy("__o"))
        lines = lines.withColumn("__k", place).filter(F.col("__k") <= k_max)
    else:
        lines = lines.orderBy("__o").limit(k_max)
    held = lines.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "line"))), lambda x: x["line"]).alias("lines"))
    held = held.withColumn("n_lines", counter.fitting("lines", head, tail, SCHEMA_SYS_PROMPT, max_context_tokens, output_reserve_tokens, OVERHEAD_TOKENS))
    return held.filter("n_lines > 0").select(
        *groups, F.col("n_lines").cast("long").alias("n_lines"),
        F.concat(F.lit(head), F.array_join(F.slice("lines", F.lit(1), F.col("n_lines")), "\n"), F.lit(tail)).alias("prompt"))


def trim_prompt_to_fit(user_col, system_prompt: str, max_context_tokens: int = 8192,
                       output_reserve_tokens: int = 1024, marker: str = SAMPLE_MARKER) -> Column:
    """PX-11: fit a prompt into ``max_context - reserve - 20 - tokens(system)``.

    Over budget and containing ``marker``: keep the text up to the marker plus
    a newline, then sample lines (as ``splitlines`` cuts them) while they fit. Still
    over budget: cut to the longest prefix within the allowance (PX-10).
    """
    u = F.col(user_col) if isinstance(user_col, str) else user_col
    budget = max_context_tokens - output_reserve_tokens
    sys_tok = py_token_estimate(system_prompt)
    limit_tok = budget - sys_tok - OVERHEAD_TOKENS          # tokens the user part may use

    def fits_len(n):
        return F.greatest(F.lit(1), F.ceil(n / 4)) <= limit_tok

    pos = F.instr(u, marker)
    before = F.concat(u.substr(F.lit(1), pos - 1 + len(marker)), F.lit("\n"))
    rest = u.substr(pos + len(marker), F.length(u))
    parts = split_lines(rest)
    blen = F.length(before)
    init = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("k"), F.lit(False).alias("stop"))

    def step(acc, line):
        s2 = acc["s"] + F.length(line) + F.when(acc["k"] > 0, 1).otherwise(0)
        ok = (~acc["stop"]) & fits_len(blen + s2)
        return F.when(ok, F.struct(s2.cast("long").alias("s"), (acc["k"] + 1).alias("k"), F.lit(False).alias("stop"))) \
            .otherwise(F.struct(acc["s"].alias("s"), acc["k"].alias("k"), F.lit(True).alias("stop")))

    k = F.aggregate(parts, init, step)["k"]
    shrunk = F.concat(before, F.array_join(F.slice(parts, 1, k), "\n"))
    stage1 = F.when(fits_len(F.length(u)), u).when(pos > 0, shrunk).otherwise(u)
    allowed = F.lit(max(limit_tok, 0))
    return F.when(fits_len(F.length(stage1)), stage1).otherwise(trim_to_tokens(stage1, allowed))


__all__ = ["compact_label_space", "labelling_prompt", "with_prompts", "pack_samples", "trim_prompt_to_fit",
           "token_estimate"]
