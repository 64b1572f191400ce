"""Spherical k-means over texts (ML-6).

A text is the set of its terms with TF-IDF weights, scaled to length one, in rows (text,
term, weight), and for the rounds one row a text with its terms as numbers. A round is one
pass over these rows: each task adds up its texts' weights under their nearest centres and
passes on one sum for each cluster and term, so no round shuffles texts or their terms. Rows
grow with the texts; terms and centres are bounded by the parameters (``vocab_size``, and
that times clusters), held by the driver and broadcast.

Sums are rounded to nine places before they are compared, so that results don't depend on
the order in which rows are added. Starting centres are texts far from each other, out of a
sample of ``SAMPLE`` texts a cluster, chosen by the hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_shipped

PLACES = 9
#: Texts a cluster from which the starting centres are chosen.
SAMPLE = 20
#: A text is far from its centre if its cosine is below the first quartile of its
#: cluster's by this many times the distance between the quartiles.
FENCE = 3.0
#: Terms of texts that a task works on at a time (or one text).
ENTRIES = 1 << 18


class Topics(NamedTuple):
    """``vectors`` (key, term, weight), ``centres`` (cluster, term, weight) and ``assigned``
    (key, cluster, cosine, far); ``key`` is the MD5 of the text."""

    vectors: DataFrame
    centres: DataFrame
    assigned: DataFrame


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def term_vectors(texts: DataFrame, text_col: str, token_pattern: str, vocab_size: int) -> DataFrame:
    """Unit vectors of the distinct texts: words and pairs of neighbouring words, the
    ``vocab_size`` most frequent terms. Texts without a term have no row."""
    words = F.filter(F.split(F.lower(F.col(text_col)), token_pattern), lambda w: w != "")
    held = texts.select(text_key(text_col).alias("key"), words.alias("w")).filter(F.size("w") > 0)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1),
                                               lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    terms = held.dropDuplicates(["key"]).select("key", F.explode(F.concat("w", pairs)).alias("term"))
    counts = cut_lineage(terms.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")))
    n = counts.select("key").distinct().count()
    frequent = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(vocab_size)
    raw = counts.join(frequent, "term").select("key", "term", (F.col("tf") * F.log((n + 1) / (F.col("df") + 1))).alias("weight")).filter("weight > 0")
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return cut_lineage(raw.join(norm, "key").select("key", "term", F.round(F.col("weight") / F.col("norm"), PLACES).alias("weight")))


def _starting(vectors: DataFrame, k: int) -> list[dict[str, float]]:
    """Up to ``k`` different texts, each as far as can be from those before it."""
    some = vectors.select("key").distinct().orderBy("key").limit(SAMPLE * k)
    held: dict[bytes, dict[str, float]] = {}
    for r in vectors.join(F.broadcast(some), "key").collect():  # SAMPLE texts a cluster
        held.setdefault(bytes(r["key"]), {})[r["term"]] = r["weight"]
    left = [held[key] for key in sorted(held)]
    near = [0.0] * len(left)
    chosen: list[dict[str, float]] = []
    while left and len(chosen) < k:
        i = min(range(len(left)), key=lambda j: (round(near[j], PLACES), j))
        if chosen and near[i] >= 1 - 1e-6:
            break
        centre = left.pop(i)
        near.pop(i)
        chosen.append(centre)
        near = [max(x, sum(w * centre.get(t, 0.0) for t, w in v.items())) for x, v in zip(near, left, strict=True)]
    return chosen


def _packed(vectors: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(key, at, weight)``: one row a text, its terms' numbers and weights."""
    entries = vectors.join(F.broadcast(numbers), "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("v"))
    return cut_lineage(entries.select("key", F.col("v.at").alias("at"), F.col("v.weight").alias("weight")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about ``ENTRIES`` terms, and for each term its row, number and weight."""
    for batch in batches:
        n = batch.column("at").value_lengths().to_numpy().astype(np.int64)
        part = (np.cumsum(n) - 1).clip(0) // ENTRIES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                some = batch.slice(a, b - a)
                yield some, np.repeat(np.arange(b - a), n[a:b]), some.column("at").flatten().to_numpy(), some.column("weight").flatten().to_numpy()


def _nearest(rows: int, row: np.ndarray, at: np.ndarray, weight: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, of equally near ones the first, and its cosine. ``centres``
    are columns."""
    cosines = np.stack([np.bincount(row, weight * c[at], rows) for c in centres.T], axis=1).round(PLACES)
    best = cosines.argmax(axis=1)
    return best, cosines[np.arange(rows), best]


def _assigned(packed: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(key, cluster, cosine)`` of each text."""
    held = packed.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, row, at, weight in _slices(batches):
            best, cosine = _nearest(some.num_rows, row, at, weight, held.value)
            yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(best.astype(np.int32)), pa.array(cosine)], names=["key", "cluster", "cosine"])

    return cut_lineage(packed.mapInArrow(run, "key binary, cluster int, cosine double"))


def _round(packed: DataFrame, centres: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, int]:
    """The sums of the texts nearest to each of the ``centres``, and how many texts were nearest
    to another of those ``before``."""
    held = packed.sparkSession.sparkContext.broadcast((centres, before))
    size, k = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, moved = np.zeros(size * k), 0
        for some, row, at, weight in _slices(batches):
            best, old = (_nearest(some.num_rows, row, at, weight, c)[0] for c in held.value)
            moved += int((best != old).sum())
            sums += np.bincount(at * k + best[row], weight, size * k)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(sums[own], moved))], names=["place", "total"])

    found = packed.mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    held.destroy()
    place, total = (found.column(c).to_numpy() for c in ("place", "total"))
    sums = np.zeros(size * k)
    sums[place[place >= 0]] = total[place >= 0]
    return sums.reshape(size, k), int(total[place < 0].sum())


def spherical_kmeans(texts: DataFrame, k: int, text_col: str, token_pattern: str, vocab_size: int, iterations: int = 20) -> Topics:
    """Cluster the distinct texts until none changes its cluster, ``iterations`` times at most."""
    spark = texts.sparkSession
    ensure_shipped(spark)
    vectors = term_vectors(texts, text_col, token_pattern, vocab_size)
    # vocab_size terms at most
    numbers = cut_lineage(vectors.select("term").distinct().select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("at")))
    terms = [r["term"] for r in numbers.orderBy("at").collect()]
    packed = _packed(vectors, numbers)
    place = {t: i for i, t in enumerate(terms)}
    centres = np.zeros((len(terms), k))
    for i, centre in enumerate(_starting(vectors, k)):
        for t, w in centre.items():
            centres[place[t], i] = w
    made = centres
    sums, _ = _round(packed, centres, centres)
    for _ in range(iterations):
        before, size = centres, np.sqrt((sums * sums).sum(axis=0))
        centres, made = (sums / np.where(size > 0, size, 1.0)).round(PLACES), sums
        sums, moved = _round(packed, centres, before)
        if not moved:
            break
    own = np.argwhere(made > 0)
    table = pa.table({"cluster": pa.array(own[:, 1], pa.int32()), "term": pa.array([terms[i] for i in own[:, 0]], pa.string()), "weight": centres[own[:, 0], own[:, 1]]})
    assigned = _assigned(packed, centres)
    quartiles = assigned.groupBy("cluster").agg(F.percentile("cosine", F.lit(0.25)).alias("low"), F.percentile("cosine", F.lit(0.75)).alias("high"))
    fence = F.col("low") - FENCE * (F.col("high") - F.col("low"))
    far = assigned.join(F.broadcast(quartiles), "cluster").select("key", "cluster", "cosine", (F.col("cosine") < fence - 10.0**-PLACES).alias("far"))
    return Topics(vectors, spark.createDataFrame(table), cut_lineage(far))
