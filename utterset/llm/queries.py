"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL
from corpus_pipeline import run as pipeline

from . import conversation_repair, langid, quality, toxicity, whitening
from .decontaminate import leaks
from .license_scan import license_scan, templates
from .line_dedup import line_dedup
from .mixing import mix
from .neardup import near_duplicates
from .oracles import SQL
from .packing import VOCABULARY, pack
from .phrase_dedup import phrase_dedup
from .simhash import simhash_classes
from .tables import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), templates(spark))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), VOCABULARY, length=2048)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(langid.learnable())
    weights = toxicity.learn(docs.join(labels, "doc_id"))
    return toxicity.score(docs, weights).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted", "offending")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.judge(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(langid.learnable()))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), (3, 1, 2), share=1.5, most=2)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), 0.75)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.repair(conversation_repair.damage(turns)), turns)


def op12_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, "embedding", components=16)
    return whitening.by_component(whitening.transform(vectors, model, "embedding"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_packing": op2_token_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash_duplicates": op12_simhash_duplicates,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {k: v for k, v in {**SQL, "pipeline": ORACLE_SQL}.items() if v and k in QUERIES}
