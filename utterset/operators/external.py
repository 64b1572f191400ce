"""Scoring with a user's own model (UD-4): loaded once per task, fed whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import probs
from ..session import ensure_shipped


def score_external(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], labels: list[str],
                   text_col: str = "text", batch: int = 256, digits: int = 4) -> DataFrame:
    """``df`` with ``intent``, ``confidence`` and ``probs MAP<label, prob>``.

    ``load()`` runs once in each task and returns ``predict(texts)``, which gives one
    row of ``len(labels)`` probabilities for each of at most ``batch`` texts. A null
    text is scored as an empty one. A result of another shape fails the job."""
    ensure_shipped(df.sparkSession)
    df = df.drop("__p")
    schema = T.StructType([*df.schema.fields, T.StructField("__p", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                got = np.asarray(predict([t or "" for t in part[text_col]]), dtype=float)
                if got.shape != (len(part), len(labels)):
                    raise ValueError(f"the model gave {got.shape} for {len(part)} texts and {len(labels)} labels")
                yield part.assign(__p=list(got))

    names = F.array(*[F.lit(x) for x in labels])
    return df.mapInPandas(run, schema).select(
        *df.columns, F.element_at(names, probs.argmax("__p") + 1).alias("intent"),
        F.round(F.array_max("__p"), digits).alias("confidence"),
        probs.prob_map(labels, F.col("__p"), digits).alias("probs")).drop("__p")
