"""Language ID with a bit-sliced Bloom filter over letter 3-grams.

One filter answers for all languages at once: each slot holds a bitmask of
languages, and the AND of an n-gram's slots is the set of languages that contain
it. A text's n-grams are looked up together, the bits are counted per language,
the counts are corrected for each language's false-positive rate, and the largest
corrected count decides.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is
every text when no row can be learned from. Ties go to the language with more
learned n-grams, then to the smaller name. A null ``doc_id`` is neither held out
nor learned from. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored, widened, without
from .wordops import mix, slices

GRAM = 3
SLOTS = 1 << 20
HASHES = 2
#: An n-gram belongs to a language if it makes up this share of the language's
#: n-grams, and at least this part of the share it has where it is most common.
#: The first bounds a language to 1 / MIN_SHARE n-grams, whatever the input's size.
MIN_SHARE = 1e-5
MIN_PART = 0.05
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def letter_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of lower-case letters (a run of anything else is one blank) as an
    integer, and the number of the text it is in."""
    low = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = np.zeros(int(code.max(initial=32)) + 1, bool)
    seen = np.flatnonzero(np.bincount(code, minlength=1))
    letter[seen] = [chr(c).isalpha() for c in seen]
    is_letter = letter[code]
    keep = is_letter.copy()  # and the first of each run of other characters
    keep[1:] |= is_letter[:-1] | (row[1:] != row[:-1])
    keep[:1] = True
    code, row = np.where(is_letter, code, 32)[keep].astype(np.uint64), row[keep]
    n = len(code) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = (gram << np.uint64(21)) | code[k : n + k]
    one = row[:n] == row[GRAM - 1 :]
    return gram[one], row[:n][one]


class LanguageFilter:
    """The bit-sliced filter: ``slices[w][slot]`` holds the bits of languages 64w to 64w+63."""

    def __init__(self, grams: dict[str, np.ndarray], slots: int = SLOTS):
        self.names = sorted(grams, key=lambda x: (-len(grams[x]), x))
        self.slots = slots
        self.slices = np.zeros(((len(self.names) + 63) // 64, slots), np.uint64)
        fill = []
        for i, name in enumerate(self.names):
            bit = np.uint64(1) << np.uint64(i % 64)
            for place in self._places(grams[name]):
                self.slices[i // 64, place] |= bit
            fill.append(np.count_nonzero(self.slices[i // 64] & bit) / slots)
        self.false_rate = np.array(fill) ** HASHES

    def _places(self, grams: np.ndarray) -> list[np.ndarray]:
        return [(mix(grams + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.slots)).astype(np.int64) for k in range(HASHES)]

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram."""
        out = None
        for place in self._places(grams):
            out = self.slices[:, place] if out is None else out & self.slices[:, place]
        return out

    def corrected(self, grams: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the n-grams contained, without the expected false
        positives; and each text's number of n-grams."""
        total = np.bincount(row, minlength=n_rows).astype(float)
        count = np.zeros((n_rows, len(self.names)))
        masks = self.languages(grams)
        for i in range(len(self.names)):
            bits = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            count[:, i] = np.bincount(row, weights=bits, minlength=n_rows)
        return np.maximum((count - total[:, None] * self.false_rate) / (1 - self.false_rate), 0), total


def learn(docs: DataFrame, min_share: float = MIN_SHARE, min_part: float = MIN_PART) -> LanguageFilter:
    """The filter of all rows of ``docs`` with a non-null ``lang``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs = np.array(part.column("lang").to_pylist(), object)
                grams, row = letter_grams(part.column("text").to_pylist())
                for lang in sorted(set(langs)):
                    value, n = np.unique(grams[langs[row] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])

    rows = docs.filter("lang is not null and text is not null").select("text", "lang") \
        .mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = stored(rows, "gram-counts")  # used for totals and shares
    total = rows.groupBy("lang").agg(F.sum("n").alias("total"))
    share = rows.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= min_share)
    # At most 1 / min_share rows a language; so is the n-gram's largest share.
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    own = share.join(best, "gram").filter(F.col("share") >= F.col("best") * min_part)
    found = own.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return LanguageFilter({r["lang"]: np.array(r["grams"], np.int64).astype(np.uint64) for r in found})


def decide(model: LanguageFilter | None) -> Callable[[list[str | None]], tuple[list[str], np.ndarray]]:
    def predict(texts):
        if model is None or not model.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, row = letter_grams(texts)
        count, total = model.corrected(grams, row, len(texts))
        best = count.argmax(axis=1)
        score = np.clip(count[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [model.names[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], score
    return predict


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the part of the text's n-grams that
    the predicted language explains."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, "lang_pred", "score")
    names = docs.columns

    def run(batches):
        label = decide(held.value)
        for batch in batches:
            for part in slices(batch):
                lang, score = label(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs, lang_pred="string", score="double"))
