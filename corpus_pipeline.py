"""From raw documents to packed token rows, in five stages.

Each stage gets what its predecessor kept as a written table and returns the columns
of ``documents`` (the last one packed rows). ``run`` applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.llm import langid
from utterset.llm.decontaminate import decontaminate
from utterset.llm.mixing import mixed_rows
from utterset.llm.neardup import near_duplicates
from utterset.llm.packing import VOCABULARY, pack
from utterset.llm.tables import read, stored

#: Part of a text's letter n-grams that its language must explain; clean texts have 0.6 and more.
LEAST_LANGUAGE_SCORE = 0.2
#: Rows (an id and a hash) up to which they are broadcast.
BROADCAST_ROWS = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay: texts without letters and texts that none
    of the languages explains go. Learned from the labelled rows that aren't held out."""
    model = langid.learn(docs.filter(langid.learnable()).select("text", "lang"))
    found = langid.predict(docs.withColumnsRenamed({"score": "__score", "lang_pred": "__lang_pred"}), model)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__score": "score", "__lang_pred": "lang_pred"})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest ``doc_id``, then text
    hash. Rows without an id come last; rows that share an id are rows of their own."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"))
    judged = near_duplicates(docs.select(key.alias("doc_id"), "text")).groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    judged = stored(judged.select(F.col("doc_id.doc_id").alias("own_id"), F.col("doc_id.text_hash").alias("own_hash"), "kept", "n"), "judged")

    def among(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        some = which.select("own_id", "own_hash")
        some = F.broadcast(some) if which.count() <= BROADCAST_ROWS else some
        return rows.join(some, rows["doc_id"].eqNullSafe(some["own_id"]) & (F.xxhash64(rows["text"]) == some["own_hash"]), how)

    own = among(docs, judged.filter("not kept"), "left_anti")
    again = judged.filter("kept and n > 1")  # equal rows; only these are shuffled
    if again.isEmpty():
        return own
    return among(own, again, "left_anti").union(among(own, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 2 times) as the mix of sources takes them."""
    return mixed_rows(docs, weights=(3, 1, 2), share=1.5, most=2)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2048 token ids."""
    return pack(docs, VOCABULARY, length=2048)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The learned language model and the seeded mix have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
