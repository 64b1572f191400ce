"""Token ids packed into rows of fixed length.

Texts are tokenized in tasks with a given public vocabulary. Every document ends in the
end token; one longer than a row is split, without loss, into pieces of a full row and
a rest. Blocks of pieces are packed best fit decreasing: the longest piece first, each
into the fullest row that still holds it, found by a segment tree over capacities.

Edge cases: null and empty texts are documents of the end token alone; a null ``doc_id``
stays null in the lists; repeated rows are packed as often as they are there; other
columns are ignored. A task's blocks hold about ``block_tokens`` tokens, or one document
if that is longer.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordops import slices

# Fixed value: the split pattern that goes with the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: A public vocabulary file, used by the queries; callers of ``pack`` give their own.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "block long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, piece_starts array<long>"


def encoder(vocabulary: bytes):
    """``encode(text) -> list of ids``, a whole text in one call."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers. The tree's leaf c counts the rows with c places left."""
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []

    def add(c: int, n: int) -> None:
        at = c + leaves
        while at:
            tree[at] += n
            at >>= 1

    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = size + leaves
        while at > 1 and not tree[at]:  # the nearest subtree to the right that has a row
            while at & 1:
                at >>= 1
            at = at + 1 if at else 0
            if not at:
                break
        if at > 1 and tree[at]:
            while at < leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
            c = at - leaves
            r = free[c].pop()
            add(c, -1)
        else:
            c, r = capacity, len(rows)
            rows.append([])
        rows[r].append(i)
        if c > size:
            free[c - size].append(r)
            add(c - size, 1)
    return rows


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end: int = END, block_tokens: int = 1 << 21) -> DataFrame:
    """One row for each row of the packed matrix: ``ids`` (``length`` little-endian
    unsigned integers, of 2 bytes if all ids fit, else 4; places after ``n_tokens`` hold
    ``end``), ``cu_seqlens`` (0, then the end of each segment), ``positions`` (of the
    same type, from 0 in each segment and in the filled-up rest), and for each segment
    its document and the token of the document at which it starts. ``block`` and ``row``
    number the rows; ``vocabulary`` is a file of base64 tokens and ranks, read by the
    driver."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size
    small = max(end, sum(1 for _ in held.value.splitlines())) < 1 << 16
    kind = "<u2" if small and length <= 1 << 16 else "<u4"

    def block(number: int, ids: list[np.ndarray], owner: list, start: list[int]) -> pa.RecordBatch:
        rows = best_fit_decreasing(np.array([len(x) for x in ids]), length)
        out = {"ids": [], "n": [], "cu": [], "positions": [], "docs": [], "starts": []}
        for row in rows:
            parts = [ids[i] for i in row]
            n = sum(map(len, parts))
            out["ids"].append(np.concatenate([*parts, np.full(length - n, end, kind)]).astype(kind).tobytes())
            out["positions"].append(np.concatenate([*(np.arange(len(x)) for x in parts), np.arange(length - n)]).astype(kind).tobytes())
            out["n"].append(n)
            out["cu"].append(np.cumsum([0, *map(len, parts)]).tolist())
            out["docs"].append([owner[i] for i in row])
            out["starts"].append([start[i] for i in row])
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(out["n"], pa.int32()),
             pa.array(out["ids"], pa.binary()), pa.array(out["cu"], pa.list_(pa.int32())), pa.array(out["positions"], pa.binary()),
             pa.array(out["docs"], pa.list_(pa.int64())), pa.array(out["starts"], pa.list_(pa.int64()))],
            names=["block", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "piece_starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(held.value)
        number = TaskContext.get().partitionId() << 32
        ids, owner, start, n = [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = np.array([*encode(text or ""), end], kind)
                    for at in range(0, len(tokens), length):
                        ids.append(tokens[at : at + length])
                        owner.append(doc)
                        start.append(at)
                    n += len(tokens)
                    if n >= block_tokens:
                        yield block(number, ids, owner, start)
                        ids, owner, start, n, number = [], [], [], 0, number + 1
        if ids:
            yield block(number, ids, owner, start)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
