"""Line dedup with two Bloom filters.

A line's key is the line without blanks at both ends and with A-Z in lower case.
One scan fills a once-seen and a twice-seen filter with the keys' hashes (each
document counts a key once). A second scan sends only suspected repeats, as 128-bit
key digests with counts summed per slice, to the exact count that confirms them
and finds the first occurrence. A third scan rewrites the texts.

Edge cases: a null or empty text is one empty line; lines with an empty key stay;
a null ``doc_id`` and repeated rows count as documents of their own; extra columns
pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import repeated
from .tables import stored, widened, without
from .wordops import slices

FILTER_BITS = 1 << 29
#: Confirmed keys (16 bytes each) that may be broadcast; more are joined by document.
BROADCAST_KEYS = 1 << 21
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    return [line.strip(BLANK).lower() for line in (text or "").encode().split(b"\n")]


def _key_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch):
        found = [h for text in part.column("text").to_pylist()
                 for h in {xxhash.xxh3_64_intdigest(k) for k in line_keys(text) if k}]
        if found:
            yield np.array(found, np.uint64)


def _digests(keys: list[bytes], suspect) -> dict[bytes, bytes]:
    """Digest of each key that the filter suspects."""
    some = [k for k in set(keys) if k]
    if not some:
        return {}
    hits = suspect.test(np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some)))
    return {k: xxhash.xxh3_128_digest(k) for k, hit in zip(some, hits, strict=True) if hit}


def repeated_lines(docs: DataFrame, min_docs: int, filter_bits: int = FILTER_BITS):
    """``(filter, keys)``: keys has ``digest``, ``n_docs`` and ``first`` (the smallest
    ``doc_id`` and line number) of every line key in ``min_docs`` documents or more."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    suspect = repeated(docs.select("text"), _key_hashes, filter_bits)

    def suspects(batches):
        for batch in batches:
            for part in slices(batch):
                count, first = Counter(), {}
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    keys = line_keys(text)
                    at = _digests(keys, suspect)
                    count.update(at.values())
                    for k, d in at.items():
                        place = (doc is None, doc or 0, keys.index(k))
                        first[d] = min(first.get(d, place), place)
                if count:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64()),
                         pa.array([None if first[d][0] else first[d][1] for d in count], pa.int64()),
                         pa.array([first[d][2] for d in count], pa.int64())],
                        names=["digest", "n", "doc_id", "line"])

    found = docs.select("doc_id", "text").mapInArrow(suspects, "digest binary, n long, doc_id long, line long")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line")
    keys = found.groupBy("digest").agg(F.sum("n").alias("n_docs"), F.min(first).alias("first")) \
        .filter(F.col("n_docs") >= min_docs)
    return suspect, stored(keys, "line-keys")


def _rewritten(text: str | None, drop) -> tuple[str, int, int]:
    """The text without the lines for which ``drop(position, key)``, and both counts."""
    lines, keys = (text or "").split("\n"), line_keys(text)
    kept = [x for i, x in enumerate(lines) if not drop(i, keys[i])]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup(docs: DataFrame, min_docs: int = 10, keep: str = "none", filter_bits: int = FILTER_BITS,
               broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with ``text`` rewritten, ``n_lines`` before and ``n_dropped``.

    Lines whose key is in ``min_docs`` documents or more go; ``keep="first"`` leaves
    the occurrence with the smallest (doc_id, line number). Up to ``broadcast_keys``
    confirmed keys travel as a broadcast; beyond that each document's own confirmed
    keys are joined to it by ``doc_id``, and nothing that grows is broadcast.
    """
    docs = without(docs, "n_lines", "n_dropped")
    names = docs.columns
    suspect, keys = repeated_lines(docs, min_docs, filter_bits)
    schema = widened(docs, n_lines="long", n_dropped="long")

    def output(part, texts):
        rows = [part.column(n) if n != "text" else pa.array([t[0] for t in texts], pa.string()) for n in names]
        return pa.RecordBatch.from_arrays(
            [*rows, pa.array([t[1] for t in texts], pa.int64()), pa.array([t[2] for t in texts], pa.int64())],
            names=[*names, "n_lines", "n_dropped"])

    def dropper(doc, keys_, at, confirmed):
        """Whether a line goes, given each digest's first place (None: none is kept)."""
        def drop(i, key):
            d = at.get(key)
            if d is None or d not in confirmed:
                return False
            return keep != "first" or confirmed[d] != (doc, i) or key in keys_[:i]
        return drop

    if keys.count() <= broadcast_keys:
        held = docs.sparkSession.sparkContext.broadcast(
            {bytes(r["digest"]): (r["first"]["doc_id"], r["first"]["line"]) for r in keys.toLocalIterator()})

        def rewrite(batches):
            confirmed = held.value
            for batch in batches:
                for part in slices(batch):
                    out = []
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        lines = line_keys(text)
                        out.append(_rewritten(text, dropper(doc, lines, _digests(lines, suspect), confirmed)))
                    yield output(part, out)

        return docs.mapInArrow(rewrite, schema)

    def own(batches):
        for batch in batches:
            for part in slices(batch):
                pairs = [(doc, d) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                         for d in _digests(line_keys(text), suspect).values()]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())],
                                                 names=["own_id", "digest"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(own, "own_id long, digest binary")
    by_doc = pairs.join(keys, "digest").groupBy("own_id") \
        .agg(F.collect_set(F.struct("digest", "first.doc_id", "first.line")).alias("confirmed_keys"))
    joined = docs.join(by_doc, docs["doc_id"].eqNullSafe(by_doc["own_id"]), "left").drop("own_id")

    def rewrite_joined(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, own_keys in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "confirmed_keys")), strict=True):
                    confirmed = {k["digest"]: (k["doc_id"], k["line"]) for k in own_keys or []}
                    lines = line_keys(text)
                    at = {k: xxhash.xxh3_128_digest(k) for k in set(lines) if k} if confirmed else {}
                    out.append(_rewritten(text, dropper(doc, lines, at, confirmed)))
                yield output(part, out)

    return joined.mapInArrow(rewrite_joined, schema)
