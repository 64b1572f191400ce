"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words, and the
document's is their noisy-or: 1 - prod(1 - score). Only documents have labels; the
gradient of the document's log loss reaches each sentence in proportion to its own
score, so what is learned also tells which sentences offend.

Words (lower case, without punctuation around them) and their first letters (stems that
take many endings) are hashed to ``SLOTS`` weights; a slot that fewer than ``MIN_DOCS`` training documents use has weight 0. Training runs on
at most about ``TRAIN_DOCS`` labelled documents, chosen by a hash of their id: every
partition trains on its own part, and the weights are averaged after each round.

Edge cases: a null or empty text, or one without words, scores 0 and has no sentences;
a null ``doc_id`` is neither held out nor learned from; labels other than 0 and 1 are
left out; a document with several label rows counts with each; without any labelled
row all texts score alike; repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored, widened, without
from .wordops import hash_strings, mix, slices, split_words

SLOTS = 1 << 18
MIN_DOCS = 5
TRAIN_DOCS = 24_000
#: Documents of a training partition, at most about; so there are TRAIN_DOCS / PART_DOCS partitions at most.
PART_DOCS = 6_000
ROUNDS, EPOCHS = 3, 3
RATE, DECAY = 0.3, 2e-4
#: Besides the whole word, its first 4 and first 5 letters are features.
PREFIXES = (4, 5)
BIAS = -6.0
MARK = "\x01"


class Bags(NamedTuple):
    """Sentences of consecutive texts: slot and sentence of each feature of a word, in the
    texts' order; text and position in the text of each sentence."""

    slots: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    number: np.ndarray


def bags(texts: pa.Array) -> Bags:
    """Sentences end at ``.``, ``!``, ``?`` or a line end; those without words don't count."""
    marked = pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"[.!?\n]+", f" {MARK} ")
    words, offsets = split_words(marked, lower=True)
    words = pc.utf8_trim(words, ",;:\"'()[]{}<>#*$%&|-_=")
    end = pc.equal(words, MARK).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # A sentence's name: its text and how many marks stand before it in all texts.
    name = np.cumsum(end) + text
    full = ~end & (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)
    names, sentence = np.unique(name[full], return_inverse=True)
    first = np.searchsorted(name[full], names)
    owner = text[full][first]
    number = np.arange(len(names)) - np.searchsorted(owner, owner)
    words = words.filter(pa.array(full))
    slot = np.empty((len(words), 1 + len(PREFIXES)), np.int64)
    for k, n in enumerate((None, *PREFIXES)):
        part = words if n is None else pc.utf8_slice_codeunits(words, 0, n)
        slot[:, k] = mix(hash_strings(part) + np.uint64(k)) % np.uint64(SLOTS)
    return Bags(slot.ravel(), np.repeat(sentence, slot.shape[1]), owner, number)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train_part(rows: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, used: np.ndarray, seed: int) -> np.ndarray:
    """AdaGrad over documents (label, slots, sentence); the last weight is the bias."""
    w, past = weights.astype(np.float64).copy(), np.full(len(weights), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, slots, sentence = rows[i]
            z = np.clip(w[-1] + np.bincount(sentence, weights=w[slots]), -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(-_softplus(z).sum())
            pull = p * (-none / max(1 - none, 1e-9) if label else 1.0)
            places = np.append(slots, len(w) - 1)
            push = np.append(pull[sentence], pull.sum() * 0.05)
            grad = np.bincount(np.unique(places, return_inverse=True)[1], weights=push)
            at = np.unique(places)
            grad = np.where(used[at], grad + DECAY * w[at], 0.0)
            past[at] += grad**2
            w[at] -= RATE * grad / np.sqrt(past[at])
    return w


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights from rows (doc_id, text, toxic); an array of ``SLOTS`` + 1 numbers."""
    spark = docs.sparkSession
    docs = docs.filter("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = docs.select("doc_id").count()
    part = min(1.0, train_docs / max(n, 1))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("mil")), F.lit(1_000_000)) < int(part * 1_000_000))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                b = bags(piece.column("text"))
                word_text = b.text[b.sentence]
                cut = np.searchsorted(word_text, np.arange(piece.num_rows + 1))
                out = [(b.slots[x:y].astype("<i4").tobytes(), (b.sentence[x:y] - (b.sentence[x] if y > x else 0)).astype("<i4").tobytes())
                       for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), pa.array([o[0] for o in out], pa.binary()),
                                                  pa.array([o[1] for o in out], pa.binary())], names=["doc_id", "toxic", "slots", "sentence"])

    held = sample.mapInArrow(featured, "doc_id long, toxic int, slots binary, sentence binary").filter("length(slots) > 0")
    parts = -(-max(1, int(n * part)) // PART_DOCS)
    held = stored(held.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts))), "bags")

    def users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("slots").to_pylist():
                count[np.unique(np.frombuffer(x, "<i4"))] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["slot", "n"])

    rows = held.select("slots").mapInArrow(users, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS).collect()
    used = np.zeros(SLOTS + 1, bool)
    used[[r["slot"] for r in rows] + [SLOTS]] = True
    weights = np.zeros(SLOTS + 1)
    weights[-1] = BIAS
    def fitter(given, turn: int):
        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("slots", "ascending")])
            data = [(y, np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(q, "<i4").astype(np.int64))
                    for y, s, q in zip(*(table.column(c).to_pylist() for c in ("toxic", "slots", "sentence")), strict=True)]
            w = train_part(data, *given.value, seed=turn)
            return pa.table({"n": pa.array([len(data)], pa.int64()), "w": pa.array([w.astype("<f8").tobytes()], pa.binary())})
        return fit

    for turn in range(ROUNDS):
        fit = fitter(spark.sparkContext.broadcast((weights, used)), turn)
        got = held.groupBy("part").applyInArrow(fit, "n long, w binary").collect()  # a row for each part
        if not got:
            break
        got = sorted((bytes(r["w"]), r["n"]) for r in got)
        weights = np.average([np.frombuffer(w, "<f8") for w, _ in got], axis=0, weights=[n for _, n in got])
    return np.where(used, weights, 0.0)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """``docs`` without ``text``, with ``score``, ``predicted`` and ``offending``: number
    and score of each sentence that alone reaches the threshold."""
    docs = without(docs, "score", "predicted", "offending")
    names = [c for c in docs.columns if c != "text"]
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in slices(batch):
                b = bags(part.column("text"))
                z = np.clip(w[-1] + np.bincount(b.sentence, weights=w[b.slots], minlength=len(b.text)), -30, 30)
                whole = 1 - np.exp(-np.bincount(b.text, weights=_softplus(z), minlength=part.num_rows))
                own = 1 / (1 + np.exp(-z))
                found: list[list] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(own >= threshold):
                    found[b.text[i]].append({"sentence": int(b.number[i]), "score": float(own[i])})
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(whole), pa.array((whole >= threshold).astype(np.int32)), pa.array(found, kind)],
                    names=[*names, "score", "predicted", "offending"])

    return docs.mapInArrow(run, widened(docs.drop("text"), score="double", predicted="int", offending="array<struct<sentence:int,score:double>>"))
