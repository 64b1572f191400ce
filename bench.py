"""Benchmark: the headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries":
{name: seconds}, "sf", plus throughput figures (texts/s) for the two scorers
to set beside the reference's stated 50-200 texts/s}. Each query is run to
completion with a no-op sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from utterset.operators import generate
    from utterset.operators import model as ml
    from utterset.operators import split
    from utterset.plans import catalog as C
    from utterset.session import local_session
    from utterset.sources import tables

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="utterset-bench")
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def run(name, build):
        t0 = time.time()
        df = build()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    # warm-up: JVM, Python workers
    C.label_counts(spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("clean_dedup_questions", lambda: C.clean_dedup_questions(spark, sf_dir))
    run("dedup_documents", lambda: C.dedup_documents(spark, sf_dir))
    run("stratified_split", lambda: C.stratified_split_labelled(spark, sf_dir))
    run("group_split", lambda: C.group_split_by_source(spark, sf_dir))
    run("conflicts", lambda: C.conflicts_by_source(spark, sf_dir))
    run("generate_1m", lambda: generate.generate(spark, 111_112, seed=42))
    run("rule_score_documents", lambda: C.rule_score_lang(spark, sf_dir))
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    extra["rule_texts_per_s"] = round(n_docs / max(times["rule_score_documents"], 1e-9), 1)
    run("eval_report", lambda: C.eval_report(spark, sf_dir))
    run("benchmark_leaks", lambda: C.benchmark_leaks(spark, sf_dir))
    run("near_dup_questions", lambda: C.near_dup_questions(spark, sf_dir))
    run("near_dup_documents", lambda: C.near_dup_documents(spark, sf_dir))
    run("annotate_cached", lambda: C.annotate_cached(spark, sf_dir))
    run("pack_prompt_by_lang", lambda: C.pack_prompt_by_lang(spark, sf_dir))
    run("merge_existing_new", lambda: C.merge_existing_new(spark, sf_dir))

    # model: train once (timed), then score every document (texts/s)
    d = tables.lang_truth(spark, sf_dir).select("doc_id", "text", F.col("y").alias("label"))
    t0 = time.time()
    s = split.stratified_split(d, "label", "doc_id", seed=42).checkpoint(eager=True)
    m, _ = ml.fit_best(s.filter("split = 'train'"), s.filter("split = 'dev'"), reg_params=(0.0,))
    times["model_train"] = round(time.time() - t0, 3)
    run("model_score_documents", lambda: ml.score(m, d.select("doc_id", "text"), keep=("doc_id",)))
    extra["model_texts_per_s"] = round(n_docs / max(times["model_score_documents"], 1e-9), 1)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir, "cpus": int(cpus), **extra}))


if __name__ == "__main__":
    main()
