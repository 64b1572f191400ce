"""Question log -> labelled, numbered, split dataset with its side tables.

The log route of the reference as one Spark job (SURVEY section 3.1):

    read -> find the text column -> clean + exact dedup (WN-1)
         -> label space (given, or induced with KMeans, ML-6)
         -> annotate every distinct text with cache and rejects (ML-1)
         -> keep non-empty label ids (FL-3) -> ids 1..n in log order (WN-4)
         -> label map (AG-7), label stats (AG-3), split (SP-2/3/4)
         -> write all artifacts (IO-10), the dataset partitioned by split.

Text never returns to the driver; only the label space (tens of rows), the
row count and the per-label counts do.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..session import cut_lineage

from ..operators import annotate, audit, labels, model, prompt, split
from ..operators.dedup import clean_questions
from ..operators.rank import dense_sequence
from ..sources import io
from ..sources.columns import resolve_question_log


def build_labelled_dataset(log: DataFrame, out_dir: str, annotator: Callable[[str], str],
                           label_space: DataFrame | None = None, pos_col: str | None = None,
                           max_labels: int = 25, parallelism: int | None = None, seed: int = 42,
                           attempts: int = 5, wait_min: float = 1.0) -> dict[str, str]:
    """Run the whole route; returns the paths of the written tables."""
    spark = log.sparkSession
    q = resolve_question_log(log, pos_col) if "src_pos" not in log.columns else log
    questions = clean_questions(q)
    if label_space is None:
        label_space, _ = model.induce_label_space(questions, max_labels=max_labels)
    # A stable order: the cache's keys hash this text, so a re-run must write the same.
    label_json = prompt.compact_label_space(label_space, order_col="id")

    labelled = annotate.annotate(questions.select("text"), annotator, label_json,
                                 cache_path=os.path.join(out_dir, "label_cache"),
                                 errors_path=os.path.join(out_dir, "errors"),
                                 parallelism=parallelism, attempts=attempts, wait_min=wait_min)
    rows = questions.join(labelled, "text").filter(F.length("label_id") > 0)
    rows = dense_sequence(rows, ["src_pos"], "id") \
        .select("id", "src_pos", "text", "label_id", "label_name", "confidence")
    rows = cut_lineage(rows)      # five sinks read it; cut the lineage once

    split_rows = split.stratified_split(rows.select("id", "text", "label_id", "label_name", "confidence"),
                                        "label_id", "id", seed=seed)
    artifacts = {
        "intent_labels": label_space,
        "labeled_dataset": rows.drop("src_pos"),
        "label_map": labels.label_map_last_wins(rows, "label_id", "label_name", "id"),
        "label_stats": audit.pair_counts(rows),
    }
    paths = io.write_artifacts(out_dir, artifacts)
    io.write_splits(split_rows, out_dir)
    paths["dataset"] = os.path.join(out_dir, "dataset")
    return paths
