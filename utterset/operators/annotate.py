"""Labelling distinct texts with a pluggable annotator and a content-keyed cache
(ML-1, ML-2, JN-1, JN-2, IO-7, IO-8).

Flow (one job, the annotator called at most once per cache miss):

1. prompts + ``cache_key = sha1(text + label_json)`` (PX-12, PX-13);
2. left join to the cache -> hits; left anti join -> misses;
3. misses, in the partitions they come in (or ``parallelism`` of them, where a
   service bounds its callers), go through ``mapInArrow`` where the annotator (user code: a remote model client, a
   local model or rules) runs with bounded retries and exponential back-off;
4. replies are parsed JVM-side (PX-14..16); a failed call or an unusable reply
   gives OTHER with confidence 0.0 and an error row, and is *not* cached;
5. the annotated misses are checkpointed to the shared folder once, so the
   cache append, the error log and the result all read the same rows and
   nothing is re-billed; only new successful rows are appended to the cache.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..session import cut_lineage, ensure_shipped, path_exists

from ..functions.batches import slices
from ..functions.replies import parse_reply, reply_error, reply_fields
from .prompt import with_prompts

# The fallback label for failed calls.
FALLBACK_ID = "OTHER"
FALLBACK_NAME = "其他/无法归类"

CACHE_SCHEMA = "cache_key STRING, label_id STRING, label_name STRING, confidence DOUBLE"


def read_cache(spark, path: str | None) -> DataFrame | None:
    """IO-7: the label cache, one row per key (a key appended twice keeps one)."""
    if not path:
        return None
    if not path_exists(spark, path):
        return None
    c = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return c.groupBy("cache_key").agg(F.min(F.struct("label_id", "label_name", "confidence")).alias("v")) \
        .select("cache_key", "v.label_id", "v.label_name", "v.confidence")


def call_with_retries(fn: Callable[[str], str], prompt: str, attempts: int = 5, wait_min: float = 1.0,
                      wait_max: float = 20.0, sleep=time.sleep) -> tuple[str | None, str | None]:
    """ML-2: call ``fn`` up to ``attempts`` times with exponential back-off.
    Returns ``(reply, None)`` or ``(None, error)``."""
    err = None
    for i in range(attempts):
        try:
            return fn(prompt), None
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {e}"
            if i + 1 < attempts:
                sleep(min(wait_max, max(wait_min, wait_min * (2 ** i))))
    return None, err


def _caller(annotator, attempts, wait_min, wait_max):
    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.column("prompt")):
                out = [call_with_retries(annotator, p, attempts, wait_min, wait_max) for p in part.column("prompt").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("cache_key"), part.column("text"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())],
                    names=["cache_key", "text", "reply", "call_error"])
    return run


def annotate(texts: DataFrame, annotator: Callable[[str], str], label_json: str,
             cache_path: str | None = None, errors_path: str | None = None, parallelism: int | None = None,
             attempts: int = 5, wait_min: float = 1.0, wait_max: float = 20.0,
             text_col: str = "text") -> DataFrame:
    """Label every row of ``texts`` (distinct texts expected, see WN-1).

    Returns ``(text, cache_key, label_id, label_name, confidence, from_cache)``.
    """
    spark = texts.sparkSession
    ensure_shipped(spark)
    todo = with_prompts(texts.select(F.col(text_col).alias("text")), label_json, "text")
    cache = read_cache(spark, cache_path)
    if cache is not None:
        hits = todo.join(cache, "cache_key", "inner").select(
            "text", "cache_key", F.upper(F.coalesce("label_id", F.lit(""))).alias("label_id"),
            F.coalesce("label_name", F.lit("")).alias("label_name"),
            F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit(True).alias("from_cache"))
        misses = todo.join(cache.select("cache_key"), "cache_key", "left_anti")
    else:
        hits, misses = None, todo
    misses = misses.select("cache_key", "text", "prompt")
    called = (misses.repartition(parallelism) if parallelism else misses).mapInArrow(
        _caller(annotator, attempts, wait_min, wait_max),
        "cache_key STRING, text STRING, reply STRING, call_error STRING")
    parsed = called.withColumn("__v", parse_reply("reply"))
    fields = reply_fields(F.col("__v"))
    parsed = parsed.withColumn("error", F.coalesce(F.col("call_error"), reply_error("reply", F.col("__v"))))
    ok = F.col("error").isNull()
    done = parsed.select(
        "text", "cache_key",
        F.when(ok, fields["label_id"]).otherwise(F.lit(FALLBACK_ID)).alias("label_id"),
        F.when(ok, fields["label_name"]).otherwise(F.lit(FALLBACK_NAME)).alias("label_name"),
        F.when(ok, fields["confidence"]).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit(False).alias("from_cache"), "error")
    done = cut_lineage(done)   # the annotator ran exactly once per miss
    if cache_path:
        done.filter(F.col("error").isNull()).select("cache_key", "label_id", "label_name", "confidence") \
            .write.mode("append").parquet(cache_path)
    if errors_path:
        done.filter(F.col("error").isNotNull()).select("text", "error").write.mode("append").json(errors_path)
    out = done.drop("error")
    return out if hits is None else hits.unionByName(out)


def keyword_annotator(rules, labels_names: dict[str, str] | None = None, confidence: float = 0.9,
                      unknown_reply: str = "无法判断") -> Callable[[str], str]:
    """A local rules annotator: reads the text out of a labelling prompt and
    replies with JSON for the first matching rule, or a non-JSON sentence
    (which the parser rejects) when no rule matches."""
    import json

    from .prompt import LABEL_USER_MID, LABEL_USER_TAIL
    ordered = sorted(rules, key=lambda r: r[0])
    names = labels_names or {}

    def reply(prompt: str) -> str:
        start = prompt.index(LABEL_USER_MID) + len(LABEL_USER_MID)
        text = prompt[start:len(prompt) - len(LABEL_USER_TAIL)].lower()
        for _, kws, lab in ordered:
            if any(k.lower() in text for k in kws):
                return json.dumps({"label_id": lab, "label_name": names.get(lab, lab), "confidence": confidence},
                                  ensure_ascii=False)
        return unknown_reply
    return reply
