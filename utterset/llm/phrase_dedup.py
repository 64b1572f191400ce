"""Substring dedup by first documents of repeated phrases.

A phrase is 13 consecutive words. Each one has an anchor: the 6 words in it whose hash
is smallest, so the same phrase has the same anchor in whatever document it stands.

1. Two Bloom filters over all documents' anchors keep the anchors that may be in two
   documents; only their phrases go on. No repeated phrase is lost.
2. A task puts the phrases of its documents into blocks of bounded size. A block keeps
   each distinct phrase once, by its hash, with the smallest ``doc_id`` it is in there.
3. Blocks' distinct phrases are dealt to buckets by the phrase's hash, not by anchor. A
   phrase comes once a block, however many documents hold it, so that a passage of all
   documents makes no bucket large. A bucket tells each block which of its phrases are
   in an earlier document of another block.
4. Each block finds the places of these phrases in its documents, and a word that a
   phrase of an earlier document covers is dropped.

Edge cases: a null text has no words; texts of fewer than 13 words lose none; a null
``doc_id`` is neither earlier nor later than another; rows of one ``doc_id`` are one
document for the comparison and are rewritten apart; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import repeated
from .tables import stored, widened, without
from .wordops import U, Words, mix, slices, split_words, windows, word_hashes

PHRASE, ANCHOR = 13, 6
FILTER_BITS = 1 << 29
SECOND_KEY = U(0xA0761D6478BD642F)
#: Phrases of a block (a slice of a batch or one long text more at most), and rows it is stored in.
BLOCK_PHRASES, PART_BITS = 1 << 19, 5
PARTS = 1 << PART_BITS
#: Phrases of a bucket, on average.
BUCKET_PHRASES = 1 << 18
BLOCK_SCHEMA = "block long, part int, at int, n long, phrases binary, checks binary, low binary, keys binary, counts binary, gaps binary, entry binary, late binary"
BLOCK_NAMES = [column.split()[0] for column in BLOCK_SCHEMA.split(", ")]
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]


def phrase_anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each phrase in order: its text, the word at which it starts, and its anchor's
    word; words count through all texts."""
    span = PHRASE - ANCHOR + 1
    count = np.maximum(np.diff(words.offsets) - PHRASE + 1, 0)
    if not count.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(count)), count)
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    start = np.arange(len(text)) - before[text] + words.offsets[text]
    flat, _ = windows(Words(words.hashes, np.array([0, len(words.hashes)])), ANCHOR)
    least = sliding_window_view(flat, span).argmin(axis=1)
    return text, start, start + least[start]


def _anchor_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch):
        words = word_hashes(part.column("text"))
        text, _, at = phrase_anchors(words)
        if len(text):
            flat, _ = windows(Words(words.hashes, np.array([0, len(words.hashes)])), ANCHOR)
            yield _distinct(text, flat[at])


def _distinct(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each text's distinct values, one text after another."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[fresh]


def _phrase_hashes(words: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each of the phrases that start at the words ``start``: a 64-bit hash of
    the words' whole hashes and 32 bits of one of other hashes of the words."""
    whole = np.array([0, len(words.hashes)])
    flat, _ = windows(Words(words.hashes, whole), PHRASE)
    other, _ = windows(Words(mix(words.hashes ^ SECOND_KEY), whole), PHRASE)
    return flat[start], other[start].astype("<u4")


def _grouped(phrase: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by phrase, and where a new phrase begins in it."""
    order = np.lexsort((check, phrase))
    phrase, check = phrase[order], check[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (phrase[1:] != phrase[:-1]) | (check[1:] != check[:-1])
    return order, fresh


def _block(block: int, held: list[tuple]) -> pa.RecordBatch:
    """One block's rows: its distinct phrases with their first document, in ``PARTS`` rows
    by hash, and a row (part -1) with the places of its documents' phrases."""
    keys, counts, docs, starts, phrase, check = (np.concatenate(x) for x in zip(*held, strict=True))
    doc = np.repeat(docs, counts)
    order, fresh = _grouped(phrase, check)
    first = np.flatnonzero(fresh)
    low = np.minimum.reduceat(doc[order], first)
    entry = np.empty(len(order), np.int32)
    entry[order] = np.cumsum(fresh) - 1
    late = low[entry] < doc
    own, check = phrase[order[first]], check[order[first]]
    cuts = np.searchsorted(own >> U(64 - PART_BITS), np.arange(PARTS + 1, dtype=U))
    rows = [(block, p, int(a), int(b - a), own[a:b].astype("<u8").tobytes(), check[a:b].tobytes(), low[a:b].astype("<i8").tobytes(), None, None, None, None, None)
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
    gaps = np.diff(starts, prepend=0)  # mostly 1: small when compressed
    rows.append((block, -1, 0, 0, None, None, None, keys.astype("<i8").tobytes(), counts.astype("<i4").tobytes(),
                 gaps.astype("<i4").tobytes(), entry.astype("<i4").tobytes(), np.packbits(late).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)


def _blocks(docs: DataFrame, suspect) -> DataFrame:
    """Blocks of about ``BLOCK_PHRASES`` phrases with a suspected anchor; all of a
    document's phrases are in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for part in slices(batch):
                words = word_hashes(part.column("text"))
                text, start, at = phrase_anchors(words)
                if not len(text):
                    continue
                flat, _ = windows(Words(words.hashes, np.array([0, len(words.hashes)])), ANCHOR)
                hit = suspect.test(flat[at])
                text, start = text[hit], start[hit]
                if not len(text):
                    continue
                rows, counts = np.unique(text, return_counts=True)
                held.append((part.column("row_key").to_numpy()[rows], counts, part.column("doc_id").to_numpy()[rows],
                             start - words.offsets[text], *_phrase_hashes(words, start)))
                n += len(start)
                if n >= BLOCK_PHRASES:
                    yield _block(block, held)
                    block, held, n = block + 1, [], 0
        if held:
            yield _block(block, held)

    # A null doc_id is neither earlier nor later than another.
    return docs.filter("doc_id is not null").mapInArrow(run, BLOCK_SCHEMA)


def _cells(blocks: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, block, at, n, phrases, checks, low)``: the blocks' distinct phrases by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                phrase, check, low = (np.frombuffer(row[n], t) for n, t in (("phrases", "<u8"), ("checks", "<u4"), ("low", "<i8")))
                bucket = ((phrase >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()),
                     pa.array([row["at"] + int(a) for a, _ in parts], pa.int32()), pa.array([int(b - a) for a, b in parts], pa.int64()),
                     pa.array([phrase[a:b].tobytes() for a, b in parts], pa.binary()),
                     pa.array([check[a:b].tobytes() for a, b in parts], pa.binary()),
                     pa.array([low[a:b].tobytes() for a, b in parts], pa.binary())],
                    names=["bucket", "block", "at", "n", "phrases", "checks", "low"])

    return blocks.filter("part >= 0").select("block", "at", "phrases", "checks", "low") \
        .mapInArrow(run, "bucket int, block long, at int, n long, phrases binary, checks binary, low binary")


def _earlier(cells: DataFrame) -> DataFrame:
    """``(block, entries)``: a block's phrases that another block has in an earlier document."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.select(["block", "at", "phrases", "checks", "low"]).to_pylist()]
        phrase, check, low = (np.concatenate([np.frombuffer(r[n], t) for r in rows]) for n, t in (("phrases", "<u8"), ("checks", "<u4"), ("low", "<i8")))
        order, fresh = _grouped(phrase, check)
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        late, ends = least < low, np.cumsum([len(r["low"]) // 8 for r in rows])
        out = [(r["block"], (np.flatnonzero(late[b - len(r["low"]) // 8 : b]) + r["at"]).astype("<i4").tobytes()) for r, b in zip(rows, ends, strict=True)]
        out = [x for x in out if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                                         names=["block", "entries"])

    return cells.groupBy("bucket").applyInArrow(run, "block long, entries binary")


def _drops(blocks: DataFrame) -> DataFrame:
    """``(row_key, starts)``: where phrases of earlier documents start in a document."""
    phrases = blocks.agg(F.sum("n")).first()[0] or 0
    earlier = _earlier(_cells(blocks, phrases // BUCKET_PHRASES + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, starts = [], []
        for row in left.to_pylist():
            counts, entry = np.frombuffer(row["counts"], "<i4"), np.frombuffer(row["entry"], "<i4")
            start = np.cumsum(np.frombuffer(row["gaps"], "<i4"))
            known = np.zeros(int(entry.max()) + 1, bool)
            for part in right.column("entries").to_pylist():
                known[np.frombuffer(part, "<i4")] = True
            late = known[entry] | np.unpackbits(np.frombuffer(row["late"], np.uint8), count=len(entry)).astype(bool)
            text = np.repeat(np.arange(len(counts)), counts)[late]
            some, at = np.unique(text, return_index=True)
            keys.append(np.frombuffer(row["keys"], "<i8")[some])
            starts += np.split(start[late].astype(np.int32), at[1:]) if len(some) else []
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        return pa.table({"row_key": pa.array(flat, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32()))})

    places = blocks.filter("part = -1").select("block", "keys", "counts", "gaps", "entry", "late")
    return places.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(run, "row_key long, starts array<int>")


def phrase_dedup(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with ``text`` as the kept words joined by one blank, ``n_words`` before
    and ``n_removed``."""
    docs = without(docs, "n_words", "n_removed")
    names = docs.columns
    own = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    suspect = repeated(docs.select("text"), _anchor_hashes, filter_bits)
    keyed = own.select(F.col("__row").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = stored(_blocks(keyed, suspect), "blocks")
    # Equal rows have equal places.
    drops = _drops(blocks).groupBy("row_key").agg(F.first("starts").alias("__starts"))
    joined = own.join(drops, own["__row"] == drops["row_key"], "left").select(*names, "__starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, offsets = split_words(part.column("text"))
                gone = np.zeros(len(words) + 1, np.int64)
                lists = pc.fill_null(pc.list_value_length(part.column("__starts")), 0).to_numpy(zero_copy_only=False)
                starts = pc.list_flatten(part.column("__starts")).to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], lists)
                np.add.at(gone, starts.astype(np.int64), 1)
                np.add.at(gone, starts.astype(np.int64) + PHRASE, -1)
                keep = np.cumsum(gone)[:-1] <= 0
                before = np.concatenate(([0], np.cumsum(keep)))[offsets]
                kept = pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.filter(pa.array(keep)).cast(pa.string()))
                text = pc.binary_join(kept, " ")
                n_words, n_kept = np.diff(offsets), np.diff(before)
                yield pa.RecordBatch.from_arrays(
                    [*(text if n == "text" else part.column(n) for n in names), pa.array(n_words), pa.array(n_words - n_kept)],
                    names=[*names, "n_words", "n_removed"])

    return joined.mapInArrow(run, widened(docs, n_words="long", n_removed="long"))
