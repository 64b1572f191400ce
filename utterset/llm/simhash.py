"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A text's fingerprint has 64 bits: one is set if it is set in more than half of the
   XXH64 hashes (seed 42) of the text's 3-word shingles, repeats included.
2. Each distinct fingerprint emits all variants within half the radius: itself and the
   64 that differ in one bit. Two fingerprints that differ in two bits or fewer have a
   variant in common, so no link is missed.
3. A variant's fingerprints are gathered as one 64-bit mask (which bit each of them
   changed), so that a group has a fixed size and is combined before the shuffle. By
   geometry a variant has 65 fingerprints at most, however many texts there are, and
   any two of them differ in two bits or fewer: links from the smallest to the others
   join the same fingerprints as all pairs would.
4. Links are deduplicated and verified by counting the bits that differ; components of
   the links give each fingerprint its class.

Edge cases: a text of fewer than three words has its whole sequence as one shingle; one
without words (null, empty, blanks) has fingerprint 0, linked like any other; repeated
rows share a fingerprint; rows with a null ``doc_id`` take part and never name a class
unless all of the class have none; an empty table gives an empty result. Extra columns
pass through; those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import stored, widened, without
from .wordops import slices, split_words

WIDTH, SEED = 3, 42
RADIUS = 2
#: Shingles whose hashes are counted at a time (64 bytes each).
BLOCK = 1 << 18


def shingle_spans(lengths: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every shingle, and each text's number of shingles."""
    n_words = np.diff(offsets)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    first = np.arange(counts.sum()) + np.repeat(offsets[:-1] - before, counts)
    return first, first + np.repeat(np.minimum(n_words, width) - 1, counts), counts


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of the texts in order, and each text's number of them."""
    words, offsets = split_words(texts, lower=True)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first, last, counts = shingle_spans(lengths, offsets)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_buffer().to_pybytes()
    start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    spans = zip(start[first].tolist(), (start[last] + lengths[last]).tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(first)), counts


def fingerprint_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's fingerprint out of its shingles' hashes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ones = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        mine = owner[at : at + BLOCK]
        fresh = np.flatnonzero(np.diff(mine, prepend=-1))
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[mine[fresh]] += np.add.reduceat(bits, fresh, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` but with ``fingerprint`` (the 64 bits as a long)."""
    docs = without(docs, "fingerprint")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = fingerprint_bits(*shingle_hashes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(prints.view(np.int64))], names=[*names, "fingerprint"])

    return docs.mapInArrow(run, widened(docs.drop("text"), fingerprint="long"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct ``fingerprint`` values of ``prints``, a < b,
    whose components are those of all pairs that differ in ``RADIUS`` bits or fewer."""
    flip = F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")  # -1: the fingerprint itself
    variants = prints.select("fingerprint", flip).withColumn("mask", F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(_bit(F.col("i"))))
    balls = variants.select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "mask", (F.col("i") < 0).cast("int").alias("own")) \
        .groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")) \
        .filter(F.bit_count("mask") + F.col("own") > 1)
    flipped = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(_bit(i)) != 0)
    members = F.concat(F.when(F.col("own") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
                       F.transform(flipped, lambda i: F.col("variant").bitwiseXOR(_bit(i))))
    pairs = balls.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def simhash_classes(docs: DataFrame) -> DataFrame:
    """``docs`` (without ``text``) with ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest ``doc_id`` reachable by links, the row itself included."""
    sketched = stored(fingerprints(without(docs, "component_id")), "fingerprints")
    classes = stored(sketched.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct")
    joined = classes.join(components(ball_links(classes)).withColumnRenamed("node", "fingerprint"), "fingerprint", "left") \
        .select("fingerprint", "id", F.coalesce("component", "fingerprint").alias("component"))
    best = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(joined.join(best, "component").select("fingerprint", "component_id"), "classes")
    return sketched.join(named, "fingerprint") \
        .select(*[c for c in sketched.columns if c != "fingerprint"], F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
