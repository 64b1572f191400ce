"""Labelling in batches whose paid replies outlive task failures (ML-2, UD-1).

``annotate`` calls one prompt at a time and stores replies when the whole job is done.
Here an annotator answers a list of prompts at once, and every answered batch is
committed by its task at once:

1. Texts without a cached or committed reply are written once and dealt by their cache
   key, sorted in each partition, so that every attempt of a task sees the same batches.
2. A batch is named by the hash of its keys. A task that finds the batch's file reads
   it; otherwise it calls the annotator, writes the replies beside it under another name
   and renames the file. A crash leaves either no file or a whole one.
3. A later run takes all committed files as part of the cache first, so a failed job,
   executor or driver costs the calls in flight and no others.
4. The calls of all tasks together stay within ``calls_per_second``: each of the
   ``parallelism`` partitions has its share, halved by every failure and slowly regained.
   Failures are retried with exponential back-off; a batch that fails for good gives
   OTHER, is logged and is not committed.

The store is a folder in any file system that the workers reach (local, hdfs, s3, ...).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_reply, reply_error, reply_fields
from ..session import cut_lineage, ensure_shipped, path_exists
from .annotate import FALLBACK_ID, FALLBACK_NAME, read_cache
from .prompt import with_prompts

BATCH_SCHEMA = "cache_key STRING, reply STRING"
#: The share of its allowance that a partition regains with each answered batch.
REGAIN = 0.1


class Pace:
    """A partition's share of the calls, and its waits after failures."""

    def __init__(self, per_second: float | None, wait_min: float, wait_max: float, sleep=time.sleep, clock=time.monotonic):
        self.most = self.rate = per_second
        self.wait_min, self.wait_max, self.sleep, self.clock = wait_min, wait_max, sleep, clock
        self.next = None

    def wait(self) -> None:
        """Until the next call is due."""
        if self.rate is None:
            return
        now = self.clock()
        if self.next is not None and self.next > now:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + 1 / self.rate

    def failed(self, attempt: int) -> None:
        if self.rate is not None:
            self.rate = max(self.rate / 2, self.most / 64)
        self.sleep(min(self.wait_max, self.wait_min * 2**attempt))

    def answered(self) -> None:
        if self.rate is not None:
            self.rate = min(self.most, self.rate + REGAIN * self.most)


class Commits:
    """The folder of committed batches, as a task sees it."""

    def __init__(self, folder: str):
        from pyarrow import fs

        if folder.startswith("file:"):
            folder = "file:///" + folder[len("file:"):].lstrip("/")
        self.files, self.folder = (fs.LocalFileSystem(), folder) if ":/" not in folder else fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)

    def read(self, name: str) -> list[dict] | None:
        from pyarrow import fs

        path = f"{self.folder}/{name}.json"
        if self.files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(path) as f:
            return [json.loads(line) for line in f.read().decode().splitlines()]

    def write(self, name: str, rows: list[dict]) -> None:
        held = f"{self.folder}/_{name}-{uuid.uuid4().hex}"  # readers skip names with an underscore
        with self.files.open_output_stream(held) as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.files.move(held, f"{self.folder}/{name}.json")


def answer(annotator: Callable[[list[str]], list[str]], keys: list[str], prompts: list[str], commits: Commits, pace: Pace,
           attempts: int) -> tuple[list[str | None], str | None]:
    """Replies to one batch, from its committed file or by a call, and the last error."""
    name = hashlib.sha256("\n".join(keys).encode()).hexdigest()
    rows = commits.read(name)
    if rows is not None:
        return [r["reply"] for r in rows], None
    error = None
    for attempt in range(attempts):
        pace.wait()
        try:
            replies = annotator(prompts)
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < attempts:
                pace.failed(attempt)
            continue
        commits.write(name, [{"cache_key": k, "reply": r} for k, r in zip(keys, replies, strict=True)])
        pace.answered()
        return replies, None
    return [None] * len(keys), error


def _answered(misses: DataFrame, annotator, store: str, batch_size: int, share: float | None, attempts: int, wait_min: float, wait_max: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commits, pace, held = Commits(store), Pace(share, wait_min, wait_max), []

        def output(rows):
            replies, error = answer(annotator, [r[0] for r in rows], [r[2] for r in rows], commits, pace, attempts)
            columns = [[r[0] for r in rows], [r[1] for r in rows], replies, [error] * len(rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["cache_key", "text", "reply", "call_error"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("cache_key", "text", "prompt")), strict=True)
            while len(held) >= batch_size:
                yield output(held[:batch_size])
                held = held[batch_size:]
        if held:
            yield output(held)

    return misses.select("cache_key", "text", "prompt").mapInArrow(run, "cache_key string, text string, reply string, call_error string")


def _parsed(replies: DataFrame, from_cache: bool) -> DataFrame:
    """Labels out of (cache_key, text, reply, call_error)."""
    held = replies.withColumn("__v", parse_reply("reply"))
    fields = reply_fields(F.col("__v"))
    held = held.withColumn("error", F.coalesce(F.col("call_error"), reply_error("reply", F.col("__v"))))
    ok = F.col("error").isNull()
    return held.select(
        "text", "cache_key", F.when(ok, fields["label_id"]).otherwise(F.lit(FALLBACK_ID)).alias("label_id"),
        F.when(ok, fields["label_name"]).otherwise(F.lit(FALLBACK_NAME)).alias("label_name"),
        F.when(ok, fields["confidence"]).otherwise(F.lit(0.0)).alias("confidence"), F.lit(from_cache).alias("from_cache"), "error")


def annotate_batches(texts: DataFrame, annotator: Callable[[list[str]], list[str]], label_json: str, store: str, cache_path: str | None = None,
                     errors_path: str | None = None, batch_size: int = 32, parallelism: int = 8, calls_per_second: float | None = None,
                     attempts: int = 5, wait_min: float = 1.0, wait_max: float = 20.0, text_col: str = "text") -> DataFrame:
    """Label the distinct texts of ``texts`` with calls of up to ``batch_size`` prompts.

    Returns ``(text, cache_key, label_id, label_name, confidence, from_cache)``; replies
    committed by earlier runs count as cached. Null texts are left out."""
    spark = texts.sparkSession
    ensure_shipped(spark)
    todo = with_prompts(texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct(), label_json, "text")
    found = []
    cache = read_cache(spark, cache_path)
    if cache is not None:
        found.append(todo.join(cache, "cache_key").select(
            "text", "cache_key", F.upper(F.coalesce("label_id", F.lit(""))).alias("label_id"), F.coalesce("label_name", F.lit("")).alias("label_name"),
            F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit(True).alias("from_cache"), F.lit(None).cast("string").alias("error")))
        todo = todo.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = []
    if path_exists(spark, store):
        committed = spark.read.schema(BATCH_SCHEMA).json(store).groupBy("cache_key").agg(F.min("reply").alias("reply"))
        # written: the files of this run must not turn up in it
        committed = cut_lineage(todo.select("cache_key", "text").join(committed, "cache_key").withColumn("call_error", F.lit(None).cast("string")))
        fresh.append(_parsed(committed, True))
        todo = todo.join(committed.select("cache_key"), "cache_key", "left_anti")
    dealt = cut_lineage(todo.select("cache_key", "text", "prompt")).repartition(parallelism, "cache_key").sortWithinPartitions("cache_key")
    share = calls_per_second / parallelism if calls_per_second else None
    fresh.append(_parsed(cut_lineage(_answered(dealt, annotator, store, batch_size, share, attempts, wait_min, wait_max)), False))
    for part in fresh:
        if cache_path:
            part.filter("error is null").select("cache_key", "label_id", "label_name", "confidence").write.mode("append").parquet(cache_path)
        if errors_path:
            part.filter("error is not null").select("text", "error").write.mode("append").json(errors_path)
    out = fresh + found
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0].drop("error")
