"""Registered queries: one per operator of the inventory, bound to driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables. Column names match the SQL oracles in ``oracle.py`` one for one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..session import cut_lineage

from ..functions.text import (collapse_space, contains_any, py_strip, remove_space, sanitize_label_id,
                              text_prefix, token_estimate, trim_to_tokens)
from ..functions import probs
from ..functions.hashing import order_key
from ..functions.tokens import token_counter
from ..functions.replies import parse_reply, reply_error, reply_fields
from ..operators.containment import contained_pairs
from ..operators.neardup import near_duplicate_links
from ..operators.rank import dense_sequence
from ..operators import annotate, audit, batch_annotate, dictionary, evaluate, external, labels, merge, prompt, rules, split, template_draws
from ..session import scratch_path
from ..sources import io, versions
from ..streaming import feeds
from ..operators import model as ml
from ..operators.dedup import clean_questions
from ..session import table
from ..sources import tables
from ..sources.columns import detect_question_column, log_positions
from .audit import leak_report, text_keys

SEED = 42

# Fixed parameters of the language rule set used on the driver tables: the
# most frequent function words of each language in ``documents``, padded with
# spaces; substring matching makes the rules imperfect on purpose (EV-*).
LANG_RULES = [
    (1, [" und ", " der ", " die "], "de"),
    (2, [" el ", " los ", " que "], "es"),
    (3, [" le ", " les ", " des "], "fr"),
    (4, [" the ", " and "], "en"),
]
LANG_LABELS = ["de", "en", "es", "fr"]
# Words whose counts make the stand-in for an external model, in the order of the labels.
SHARE_WORDS = [" und ", " the ", " el ", " le "]


# --- cleaning / dedup ------------------------------------------------------

def clean_dedup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_questions(tables.question_log(spark, sf_dir))


def rule_intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: question log -> clean -> dedup -> keyword rules -> counts."""
    q = clean_questions(tables.question_log(spark, sf_dir))
    scored = rules.score_rules(q, rules.rules_frame(spark), rules.REFERENCE_LABELS, seed=SEED,
                               with_probs=False)
    return scored.groupBy("intent").agg(F.count(F.lit(1)).alias("count"),
                                        evaluate.exact_mean(F.col("confidence")).alias("mean_confidence"))


def rule_score_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = clean_questions(tables.question_log(spark, sf_dir))
    scored = rules.score_rules(q, rules.rules_frame(spark), rules.REFERENCE_LABELS, seed=SEED,
                               with_probs=False)
    return scored.select("src_pos", "intent", "confidence")


def lang_scored(spark: SparkSession, sf_dir: str, with_probs: bool = False) -> DataFrame:
    docs = tables.lang_truth(spark, sf_dir)
    return rules.score_rules(docs, rules.rules_frame(spark, LANG_RULES), LANG_LABELS, seed=SEED,
                             with_probs=with_probs)


def rule_score_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_scored(spark, sf_dir).select("doc_id", "intent", "confidence")


def rule_many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8 with hundreds of keywords: each word of six letters or more of ``benchmark``
    is a rule; the first word in order that a document contains gives its label."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("keyword"))
    rule = words.distinct().select(F.lit(1).alias("priority"), "keyword", F.concat(F.lit("HAS_"), "keyword").alias("label"))
    return rules.match_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), rule).select("doc_id", "rule_label")


def rule_word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8 with a dictionary that grows with the corpus: every distinct word of
    ``documents`` is a keyword; the longest one that a document contains gives its label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = dictionary.distinct_words(docs)
    rule = words.select((-F.length("keyword")).alias("priority"), "keyword", F.concat(F.lit("HAS_"), "keyword").alias("label"))
    return dictionary.match_dictionary(docs, rule).select("doc_id", "rule_label")


def rule_probs_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX-20/21 long form: one row per (document, label) with its probability."""
    s = lang_scored(spark, sf_dir, with_probs=True)
    return s.select("doc_id", F.explode("probs").alias("label", "prob"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    collapse_space("text").alias("collapsed"),
                    remove_space("text").alias("no_space"),
                    py_strip("text").alias("stripped"),
                    F.upper(py_strip("lang")).alias("lang_upper"),
                    text_prefix("text", 300).alias("prefix300"),
                    token_estimate("text").alias("tokens"),
                    trim_to_tokens("text", 64).alias("trimmed64"))


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")) \
        .select("doc_id", "copies")


def label_rows_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL-7, FL-8: the documents of one label that contain any of some words."""
    d = table(spark, sf_dir, "documents").filter(F.col("lang") == "de")
    return d.filter(contains_any(F.lower("text"), [" und ", " oder ", " the "])).select("doc_id", "lang")


def sanitize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", sanitize_label_id(F.col("url"), F.col("html")).alias("label_id"),
                    sanitize_label_id(F.regexp_replace("url", "[A-Za-z0-9]", ""), F.col("url")).alias("fallback_id"))


# --- aggregates -------------------------------------------------------------

def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_counts(tables.labelled_set(spark, sf_dir))


def label_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("label_id"),
                                                 F.col("lang").alias("label_name"))
    return audit.pair_counts(d)


def conflicts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.conflicts(tables.source_labelled(spark, sf_dir))


def column_lengths_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.column_mean_lengths(table(spark, sf_dir, "pages"))


def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("conversations", "documents", "pages", "customer"):
        col, rule = detect_question_column(table(spark, sf_dir, name))
        rows.append((name, col, rule))
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING, rule STRING")


# --- splits -----------------------------------------------------------------

def stratified_split_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.labelled_set(spark, sf_dir)
    return split.stratified_split(d, "label", "doc_id", seed=SEED).select("doc_id", "label", "split")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stratified_split_labelled(spark, sf_dir)
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("count"))


def prefix_split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.source_labelled(spark, sf_dir)
    return split.per_label_prefix_split(d, "label", "doc_id", seed=SEED).select("doc_id", "label", "split")


def group_split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.source_labelled(spark, sf_dir)
    s = split.group_split(d, "text", "label", "doc_id", seed=SEED)
    return s.select("doc_id", "label", "group_label", "fold", "split")


def group_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.source_labelled(spark, sf_dir)
    s = split.group_split(d, "text", "label", "doc_id", seed=SEED)
    leaked = split.leaked_groups(s)
    return leaked.agg(F.count(F.lit(1)).alias("leaked_groups"))


def exact_overlap_train_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.source_labelled(spark, sf_dir)
    s = split.stratified_split(d, "label", "doc_id", seed=SEED)
    tr, dv = s.filter("split = 'train'"), s.filter("split = 'dev'")
    return audit.exact_overlap(tr, dv).select(F.sha1("text").alias("text_sha1"),
                                              F.length("text").alias("n_chars"))


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit route: leakage between train and dev, re-split by group, audit again."""
    keyed = text_keys(tables.source_labelled(spark, sf_dir), SEED)
    s = cut_lineage(split.stratified_split(keyed, "label", "doc_id", seed=SEED).withColumnRenamed("doc_id", "pos"))
    train, dev = (s.filter(F.col("split") == name).drop("split") for name in ("train", "dev"))
    return leak_report(train, dev, seed=SEED)


# --- evaluation -------------------------------------------------------------

def _lang_pairs(spark, sf_dir):
    return lang_scored(spark, sf_dir).select("doc_id", "y", F.col("intent").alias("pred"), "confidence")


def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_scores(_lang_pairs(spark, sf_dir))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(_lang_pairs(spark, sf_dir))


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_long(_lang_pairs(spark, sf_dir))


def eval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confidence_by_label(_lang_pairs(spark, sf_dir), threshold=0.86)


def eval_top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_confusions(_lang_pairs(spark, sf_dir), k=5)



# --- generation -------------------------------------------------------------

def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GE-1..GE-3 from given tables: templates of each nation, labelled by region; values out
    of parts, suppliers, orders and customers; as many samples as a region has customers."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.col("n_name")
    forms = F.array(
        F.concat(F.lit("Which {type} parts does {supplier} ship to "), name, F.lit("?")),
        F.concat(F.lit("Is {supplier} the cheapest source of {brand} in "), name, F.lit("?")),
        F.concat(name, F.lit(": how are {priority} orders of the {segment} segment?")),
        F.concat(F.lit("Call the desk in "), name))
    templates = nation.select(F.col("r_name").alias("label"), F.explode(forms).alias("template"))
    columns = (("type", "part", "p_type"), ("brand", "part", "p_brand"), ("supplier", "supplier", "s_name"),
               ("priority", "orders", "o_orderpriority"), ("segment", "customer", "c_mktsegment"))
    values = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.lit(slot).alias("slot"), F.col(c).alias("value")).distinct() for slot, t, c in columns])
    wanted = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")) \
        .groupBy(F.col("r_name").alias("label")).agg(F.count(F.lit(1)).alias("wanted"))
    return template_draws.draw(templates, values, wanted, seed=SEED)


def generate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir)


def generate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("distinct_texts"),
        F.min(F.length("text")).alias("min_len"), F.max(F.length("text")).alias("max_len"))


def generate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = utterances(spark, sf_dir)
    return split.per_label_prefix_split(g, "label", "sample_idx", seed=SEED).select("label", "sample_idx", "split")


# --- merge and label dictionaries -------------------------------------------

def _two_generations(spark, sf_dir):
    d = tables.source_labelled(spark, sf_dir)
    old = split.per_label_prefix_split(d, "label", "doc_id", seed=SEED)
    new = split.per_label_prefix_split(d, "label", "doc_id", seed=7)
    return old, new


def merge_existing_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_generations(spark, sf_dir)
    return merge.merge_splits(old, new, pos_col="doc_id").select("split", "doc_id", "label", "origin")


def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_generations(spark, sf_dir)
    merged = merge.merge_splits(old, new, pos_col="doc_id")
    return merge.merge_stats(old, new, merged)


def merged_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GE-4, IO-5, IO-6, SE-2, SP-7, AG-2: a set and its label index are written as one version,
    a new generation is merged into them as the next, and what is current is counted."""
    old, new = _two_generations(spark, sf_dir)
    base = scratch_path(spark, "versions")

    def tables_of(rows: DataFrame, index: DataFrame) -> dict:
        return {"dataset": (rows, "parquet", ["split"]), "label_mapping": (index, "parquet", [])}

    first = versions.replace(spark, base, tables_of(old.select("split", "text", "label", "doc_id"), labels.label_index(old)), None)
    held, index = versions.read_current(spark, base, "dataset"), versions.read_current(spark, base, "label_mapping")
    merged = merge.merge_splits(held, new.select("split", "text", "label", "doc_id"), pos_col="doc_id")
    versions.replace(spark, base, tables_of(merged.select("split", "text", "label", "doc_id"), labels.extend_label_index(index, new)), first)
    rows = labels.attach_label_ids(versions.read_current(spark, base, "dataset"), versions.read_current(spark, base, "label_mapping"))
    return rows.groupBy("split", "label", "label_idx").agg(F.count(F.lit(1)).alias("count"))


def label_index_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.labelled_set(spark, sf_dir)
    existing = labels.label_index(d.filter(F.col("label").startswith("Q1")))
    return labels.extend_label_index(existing, d)


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label_id"),
                                                 F.col("lang").alias("label_name"))
    return labels.label_map_last_wins(d, "label_id", "label_name", "doc_id")


def label_map_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label_id"),
                                                 F.col("lang").alias("label_name"))
    return labels.inverse_map_last_wins(d, "label_id", "label_name", "doc_id")


KNOWN_LANGS = ["DE", "EN", "FR"]


def unknown_labels_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.normalize_labels(table(spark, sf_dir, "documents").select(F.col("lang").alias("label")))
    known = spark.createDataFrame([(x,) for x in KNOWN_LANGS], "label STRING")
    return labels.unknown_labels(d, known)


def label_ids_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.labelled_set(spark, sf_dir)
    return labels.attach_label_ids(d, labels.label_index(d)).select("doc_id", "label", "label_idx")


# --- replies, annotation, prompts ---------------------------------------------

# Fixture expression (valid in Spark SQL and DuckDB): annotator replies in every
# shape the parser must handle, made from the documents' own fields.
REPLY_SQL = """CASE doc_id % 8
 WHEN 0 THEN '{"label_id": "' || lang || '", "label_name": "' || source || '", "confidence": 0.' || CAST(doc_id % 97 + 3 AS STRING) || '}'
 WHEN 1 THEN '```json' || chr(10) || '{"label_id": "' || lang || '", "confidence": 0.8}' || chr(10) || '```'
 WHEN 2 THEN 'Sure, here it is: {"label_id": "' || upper(lang) || '", "label_name": "' || source || '"} Thanks!'
 WHEN 3 THEN '{"label_id": "' || lang || '", "confidence": "0.75",}'
 WHEN 4 THEN 'I cannot decide for ' || source
 WHEN 5 THEN ''
 WHEN 6 THEN '{"label_id": "' || lang || '", "confidence": "high"}'
 ELSE CASE WHEN doc_id % 16 = 7 THEN '{"label_id": "' || lang || '", "confidence": true}'
           ELSE '["' || lang || '"]' END END"""


def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(REPLY_SQL).alias("reply"))
    d = d.withColumn("__v", parse_reply("reply"))
    f = reply_fields(F.col("__v"))
    d = d.withColumn("error", reply_error(F.col("reply"), F.col("__v")))
    ok = F.col("error").isNull()
    return d.select("doc_id",
                    F.when(ok, f["label_id"]).otherwise(F.lit(annotate.FALLBACK_ID)).alias("label_id"),
                    F.when(ok, f["label_name"]).otherwise(F.lit(annotate.FALLBACK_NAME)).alias("label_name"),
                    F.when(ok, f["confidence"]).otherwise(F.lit(0.0)).alias("confidence"),
                    "error")


def lang_label_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label space derived from the data: one label per document language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.countDistinct("source").alias("n_src")).select(
        F.col("lang").alias("id"), F.col("lang").alias("name"),
        F.concat(F.lit("Documents written in "), F.col("lang"), F.lit(" from "),
                 F.col("n_src").cast("string"), F.lit(" sources.")).alias("description"))


def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label_json = prompt.compact_label_space(lang_label_space(spark, sf_dir), order_col="id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prompt.with_prompts(d, label_json).select("doc_id", "cache_key", "prompt")


def annotate_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelling runs sharing one cache: the training texts first, then
    every text; the second run reuses cached labels and calls the annotator
    only for the rest. Failed replies are neither cached nor reused."""
    label_json = prompt.compact_label_space(lang_label_space(spark, sf_dir), order_col="id")
    fn = annotate.keyword_annotator(LANG_RULES)
    cache, errors = scratch_path(spark, "label-cache"), scratch_path(spark, "label-errors")
    d = tables.source_labelled(spark, sf_dir)
    train = split.per_label_prefix_split(d, "label", "doc_id", seed=SEED).filter("split = 'train'")
    annotate.annotate(train.select("text").distinct(), fn, label_json, cache, errors, attempts=1).count()
    out = annotate.annotate(d.select("text").distinct(), fn, label_json, cache, errors, attempts=1)
    return out.select(F.sha1("text").alias("text_sha1"), "label_id", "label_name", "confidence", "from_cache")


def annotation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-8: the error log of a run over all documents, read back."""
    label_json = prompt.compact_label_space(lang_label_space(spark, sf_dir), order_col="id")
    errors = scratch_path(spark, "label-errors")
    texts = table(spark, sf_dir, "documents").select("text").distinct()
    annotate.annotate(texts, annotate.keyword_annotator(LANG_RULES), label_json, None, errors, attempts=1)
    return spark.read.schema("text string, error string").json(errors).select(F.sha1("text").alias("text_sha1"), "error")


def pack_schema_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = clean_questions(tables.question_log(spark, sf_dir))
    return prompt.pack_samples(q, order_col="src_pos")


def pack_prompt_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return prompt.pack_samples(d, order_col="doc_id", group_cols=["lang"])


TRIM_CONTEXT, TRIM_RESERVE = 512, 128


def trim_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    u = F.concat(F.lit(prompt.SAMPLE_MARKER + "\n"), F.col("text"))
    return d.select("doc_id", prompt.trim_prompt_to_fit(u, prompt.SCHEMA_SYS_PROMPT, TRIM_CONTEXT,
                                                        TRIM_RESERVE).alias("prompt"))


# --- exact token counts, batches of calls ---------------------------------------

#: A public byte-pair vocabulary; its path is a parameter of ``token_counter``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD-3: exact tokens of every document, beside the estimate."""
    counter = token_counter(spark, VOCABULARY)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", counter.count("text").alias("n_tokens"), token_estimate("text").alias("estimate"))


def trim_to_exact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX-10 with exact tokens: every document's prefix of at most 64 tokens."""
    counter = token_counter(spark, VOCABULARY)
    d = table(spark, sf_dir, "documents").select("doc_id", counter.trim("text", 64).alias("prefix"))
    return d.select("doc_id", F.length("prefix").alias("n_chars"), F.sha1("prefix").alias("prefix_sha1"))


def trim_prompts_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX-11 with exact tokens."""
    counter = token_counter(spark, VOCABULARY)
    u = F.concat(F.lit(prompt.SAMPLE_MARKER + "\n"), F.col("text"))
    trimmed = counter.trim_prompt(u, prompt.SCHEMA_SYS_PROMPT, prompt.SAMPLE_MARKER, TRIM_CONTEXT, TRIM_RESERVE, prompt.OVERHEAD_TOKENS)
    return table(spark, sf_dir, "documents").select("doc_id", trimmed.alias("prompt"))


def pack_prompt_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-5 with exact tokens: one prompt a language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return prompt.pack_samples_exact(d, token_counter(spark, VOCABULARY), order_col="doc_id", group_cols=["lang"])


def annotate_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2, UD-1: labels by calls of 32 prompts. The second run takes the replies that the
    first one, over the training texts, committed; it has no label cache."""
    label_json = prompt.compact_label_space(lang_label_space(spark, sf_dir), order_col="id")
    one = annotate.keyword_annotator(LANG_RULES)
    store = scratch_path(spark, "replies")

    def answers(prompts):
        return [one(p) for p in prompts]

    d = tables.source_labelled(spark, sf_dir)
    train = split.per_label_prefix_split(d, "label", "doc_id", seed=SEED).filter("split = 'train'")
    batch_annotate.annotate_batches(train.select("text"), answers, label_json, store, attempts=1).count()
    out = batch_annotate.annotate_batches(d.select("text"), answers, label_json, store, attempts=1)
    return out.select(F.sha1("text").alias("text_sha1"), "label_id", "label_name", "confidence", "from_cache")


# --- arrays, sequences, samples ---------------------------------------------------

def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = probs.with_softmax(table(spark, sf_dir, "embeddings"), "embedding", "p")
    return e.select("vec_id", probs.argmax("embedding").alias("pred_idx"),
                    F.round(F.array_max("p"), 4).alias("confidence"))


def top2_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = probs.with_softmax(table(spark, sf_dir, "embeddings"), "embedding", "p")
    t = e.select("vec_id", F.posexplode(probs.top_k("p", 2)).alias("pos", "item"))
    return t.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("item.idx").alias("class_idx"),
                    F.col("item.prob").alias("prob"))


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = clean_questions(tables.question_log(spark, sf_dir))
    return dense_sequence(q, ["src_pos"], "id").select("id", "src_pos")


def log_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-1: a question log without a key, as JSON files, read back; its rows are numbered in
    the order in which they stand there."""
    path = scratch_path(spark, "log")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    ordered = turns.repartitionByRange(8, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    io.write_table(ordered.select("text", "conv_id", "turn"), path, "json")
    log = io.read_table(spark, path, "json", schema="text string, conv_id long, turn long")
    return log_positions(log).select("src_pos", "conv_id", "turn", F.sha1("text").alias("text_sha1"))


def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = clean_questions(tables.question_log(spark, sf_dir))
    return q.orderBy("src_pos").limit(400)


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(order_key(SEED, "doc_id"), "doc_id").limit(200)


# --- held-out leakage ---------------------------------------------------------

def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contained_pairs(docs, items)


def benchmark_leak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = benchmark_leaks(spark, sf_dir)
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# --- near duplicates (no SQL oracle: difflib; checked by brute force in tests) -----

def _question_splits(spark, sf_dir):
    q = clean_questions(tables.question_log(spark, sf_dir)).select(F.col("src_pos").alias("id"), "text")
    return split.unstratified_split(q, "id", seed=SEED)


def near_dup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5: dev questions with a near-duplicate (ratio >= 0.95) in train."""
    s = _question_splits(spark, sf_dir)
    dev = s.filter("split = 'dev'").select("id", "text")
    train = s.filter("split = 'train'").select("id", "text")
    return near_duplicate_links(dev, train, threshold=0.95)[0]


def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5 on whole documents: dev vs train of the source-labelled split, as links between
    distinct texts; ``near_dup_members`` has the rows of each."""
    d = tables.source_labelled(spark, sf_dir)
    s = split.stratified_split(d, "label", "doc_id", seed=SEED)
    return near_duplicate_links(*_document_sides(s), threshold=0.95)[0]


def _document_sides(s: DataFrame) -> list[DataFrame]:
    return [s.filter(F.col("split") == side).select(F.col("doc_id").alias("id"), "text") for side in ("dev", "train")]


def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5: which documents hold a text with a near-duplicate on the other side."""
    d = tables.source_labelled(spark, sf_dir)
    s = split.stratified_split(d, "label", "doc_id", seed=SEED)
    links, members = near_duplicate_links(*_document_sides(s), threshold=0.95)
    links = cut_lineage(links.select("left_rep", "right_rep"))
    linked = links.select(F.lit(0).alias("side"), F.col("left_rep").alias("rep")).union(links.select(F.lit(1), "right_rep")).distinct()
    return members.join(linked, ["side", "rep"], "left_semi").select("side", "id", "rep")


# --- streaming, files, model, whole route -------------------------------------------

def stream_score_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: the conversation file as a stream; user turns scored by the rules."""
    schema = table(spark, sf_dir, "conversations").schema
    feed = feeds.table_feed(spark, sf_dir, "conversations.parquet", schema).filter(F.col("role") == "user")
    out, rej, ck = scratch_path(spark, "scored"), scratch_path(spark, "rejects"), scratch_path(spark, "ck")
    q1, q2 = feeds.score_feed(feed, rules.rules_frame(spark), rules.REFERENCE_LABELS, out, rej, ck, seed=SEED)
    q1.awaitTermination()
    q2.awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "intent", "confidence")


def stream_merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: documents streamed into a (text, label) de-duplicated table."""
    schema = table(spark, sf_dir, "documents").schema
    feed = feeds.table_feed(spark, sf_dir, "documents.parquet", schema) \
        .select("text", F.col("source").alias("label"), F.col("doc_id").alias("pos"))
    path, ck = scratch_path(spark, "merged"), scratch_path(spark, "ck")
    feeds.merge_feed(feed, path, ck).awaitTermination()
    return spark.read.parquet(path).select("pos", "label", F.sha1("text").alias("text_sha1"))


def stream_merge_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 with keyed state: documents streamed into the set of labelled ones; what that
    set lacks comes out."""
    docs = table(spark, sf_dir, "documents")
    existing = tables.labelled_set(spark, sf_dir).select("doc_id").join(docs, "doc_id").select("text", F.col("source").alias("label"))
    feed = feeds.table_feed(spark, sf_dir, "documents.parquet", docs.schema) \
        .select("text", F.col("source").alias("label"), F.col("doc_id").alias("pos"))
    path, ck = scratch_path(spark, "merged"), scratch_path(spark, "ck")
    feeds.merge_keyed_feed(feed, path, ck, existing).awaitTermination()
    return spark.read.schema("text string, label string, pos long").parquet(path).select("pos", "label", F.sha1("text").alias("text_sha1"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-2/IO-3: the labelled set through CSV (quotes, commas, newlines) and back."""
    d = tables.labelled_set(spark, sf_dir)
    path = scratch_path(spark, "csv")
    io.write_table(d, path, "csv")
    back = io.read_table(spark, path, "csv")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "label",
                       F.sha1("text").alias("text_sha1"), F.length("text").alias("n_chars"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-2, FL-2, PX-5, FL-4: the training loader on a CSV of all documents with
    padded lower-case labels."""
    path = scratch_path(spark, "training")
    padded = F.concat(F.lit("  "), F.lower("lang"), F.lit(" "))
    io.write_table(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sentence"), padded.alias("label")), path, "csv")
    known = table(spark, sf_dir, "documents").select(F.upper("lang").alias("label")).distinct()
    rows = io.read_labelled_csv(spark, path, known, keep=("doc_id",))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.sha1("text").alias("text_sha1"))


def _word_share_model():
    """A stand-in for a user's model: each language's share of the counted words."""
    def predict(texts):
        counts = np.array([[1 + t.count(w) for w in SHARE_WORDS] for t in texts], dtype=float)
        return counts / counts.sum(axis=1, keepdims=True)
    return predict


def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD-4: all documents scored by a model that the user brings."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external.score_external(d, _word_share_model, LANG_LABELS).select("doc_id", "intent", "confidence")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-4: the labelled set as JSON Lines and back."""
    d = tables.labelled_set(spark, sf_dir)
    path = scratch_path(spark, "json")
    io.write_table(d, path, "json")
    back = io.read_table(spark, path, "json")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "label",
                       F.sha1("text").alias("text_sha1"), F.length("text").alias("n_chars"))


def model_eval_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-4/ML-5/EV-3: train on the train split (language as label), select on
    dev by macro-F1, report on test."""
    d = tables.lang_truth(spark, sf_dir).select("doc_id", "text", F.col("y").alias("label"))
    s = cut_lineage(split.stratified_split(d, "label", "doc_id", seed=SEED))
    m, _ = ml.fit_best(s.filter("split = 'train'"), s.filter("split = 'dev'"))
    pred = ml.score(m, s.filter("split = 'test'"), keep=("label",))
    return evaluate.report(pred.select(F.col("label").alias("y"), F.col("intent").alias("pred")))


def model_rounds_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-4: training in rounds; the curve of the scores on dev, and which round is kept."""
    d = tables.lang_truth(spark, sf_dir).select("doc_id", "text", F.col("y").alias("label"))
    s = cut_lineage(split.stratified_split(d, "label", "doc_id", seed=SEED))
    _, curve = ml.fit_rounds(s.filter("split = 'train'"), s.filter("split = 'dev'"))
    return curve.select("round", "iterations", F.round("loss", 6).alias("loss"), "macro_f1", "best")


def induced_label_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6: a label space induced from the question log."""
    q = clean_questions(tables.question_log(spark, sf_dir))
    space, assign = ml.induce_label_space(q, max_labels=8)
    sizes = assign.groupBy("label_id").agg(F.count(F.lit(1)).alias("n_questions"))
    return space.join(sizes, space["id"] == sizes["label_id"], "left") \
        .select("id", "name", F.coalesce("n_questions", F.lit(0)).alias("n_questions"))


def build_dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log route (section 3.1) with the keyword annotator; returns the
    written dataset's sizes per split and label."""
    from .build_dataset import build_labelled_dataset
    log = tables.question_log(spark, sf_dir)
    space = lang_label_space(spark, sf_dir)
    fn = annotate.keyword_annotator(LANG_RULES)
    out = scratch_path(spark, "build")
    paths = build_labelled_dataset(log, out, fn, label_space=space, attempts=1)
    ds = spark.read.parquet(paths["dataset"])
    return ds.groupBy("split", "label_id").agg(F.count(F.lit(1)).alias("count"))

QUERIES = {
    "clean_dedup_questions": clean_dedup_questions,
    "rule_intent_counts": rule_intent_counts,
    "rule_score_questions": rule_score_questions,
    "rule_score_lang": rule_score_lang,
    "rule_many_keywords": rule_many_keywords,
    "rule_word_dictionary": rule_word_dictionary,
    "rule_probs_lang": rule_probs_lang,
    "normalize_documents": normalize_documents,
    "dedup_documents": dedup_documents,
    "label_rows_with_words": label_rows_with_words,
    "sanitize_ids": sanitize_ids,
    "label_counts": label_counts,
    "label_pair_counts": label_pair_counts,
    "conflicts_by_source": conflicts_by_source,
    "column_lengths_pages": column_lengths_pages,
    "detect_columns": detect_columns,
    "stratified_split_labelled": stratified_split_labelled,
    "split_sizes": split_sizes,
    "prefix_split_by_source": prefix_split_by_source,
    "group_split_by_source": group_split_by_source,
    "group_split_leak": group_split_leak,
    "leak_audit": leak_audit,
    "exact_overlap_train_dev": exact_overlap_train_dev,
    "eval_macro": eval_macro,
    "eval_report": eval_report,
    "eval_confusion": eval_confusion,
    "eval_confidence": eval_confidence,
    "eval_top_confusions": eval_top_confusions,
    "generate_samples": generate_samples,
    "generate_stats": generate_stats,
    "generate_split": generate_split,
    "merge_existing_new": merge_existing_new,
    "merge_report": merge_report,
    "merged_dataset_counts": merged_dataset_counts,
    "label_index_extend": label_index_extend,
    "label_map": label_map,
    "label_map_inverse": label_map_inverse,
    "unknown_labels_lang": unknown_labels_lang,
    "label_ids_labelled": label_ids_labelled,
    "parse_replies": parse_replies,
    "render_prompts": render_prompts,
    "annotate_cached": annotate_cached,
    "annotation_errors": annotation_errors,
    "pack_schema_prompt": pack_schema_prompt,
    "pack_prompt_by_lang": pack_prompt_by_lang,
    "trim_prompts": trim_prompts,
    "token_counts": token_counts,
    "trim_to_exact_tokens": trim_to_exact_tokens,
    "trim_prompts_exact": trim_prompts_exact,
    "pack_prompt_exact": pack_prompt_exact,
    "annotate_batched": annotate_batched,
    "softmax_argmax": softmax_argmax,
    "top2_probs": top2_probs,
    "sequence_ids": sequence_ids,
    "log_row_numbers": log_row_numbers,
    "first_questions": first_questions,
    "seeded_sample": seeded_sample,
    "benchmark_leaks": benchmark_leaks,
    "benchmark_leak_counts": benchmark_leak_counts,
    "near_dup_questions": near_dup_questions,
    "near_dup_documents": near_dup_documents,
    "near_dup_members": near_dup_members,
    "stream_score_questions": stream_score_questions,
    "stream_merge_documents": stream_merge_documents,
    "stream_merge_keyed": stream_merge_keyed,
    "csv_round_trip": csv_round_trip,
    "json_round_trip": json_round_trip,
    "training_rows": training_rows,
    "external_scores": external_scores,
    "model_eval_lang": model_eval_lang,
    "model_rounds_lang": model_rounds_lang,
    "induced_label_space": induced_label_space,
    "build_dataset_sizes": build_dataset_sizes,
}
