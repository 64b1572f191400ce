"""Keyword dictionaries of any size (JN-8).

``rules.match_rules`` ships a small dictionary to the tasks. One that grows with the
data (all words of a corpus, all names of a register) fits neither the driver nor a
task; here it stays a table:

1. A keyword of n characters has pieces of q characters, q the largest of 8, 4, 2, 1 up
   to n. A text that contains the keyword contains all of its pieces, so keywords with
   a piece that no text has are dropped, and each other one is looked for by the piece
   that the fewest texts have, its anchor.
2. Texts' pieces and anchors meet in an equi-join on the piece's hash; copies of a text
   are one text there. Boilerplate is no keyword's anchor if the keyword has another piece.
3. A text's candidates come to it as one list in the order of the rules. The first that
   the text really contains gives its label; long texts with many candidates are passed
   once through an automaton of their own candidates instead.

Keywords of up to ``LONGEST`` characters need no candidates: a text's substrings of the
keywords' lengths are hashed in Arrow batches, and those whose hash a bitmap of the keywords
does not have are dropped there. A table of slots has, for each part of the hashes, the first
rule there and its hash: so a task knows the numbers of most of the rules that a text
contains, and keeps the least. Only hashes whose slot's first rule is another one, and before
that least, meet the keywords in an equi-join on the hash. The least rule number of a text is
its answer once the text is seen to contain the keyword; the few texts where two hashes fell
together go through steps 1 to 3.

Nothing is collected but the bitmap and the slots, of bounded size; sides are broadcast only
below ``BROADCAST_ROWS`` counted rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..session import cut_lineage, ensure_shipped
from .rank import bounded_broadcast, dense_sequence

PIECES = (8, 4, 2, 1)
BROADCAST_ROWS = 1 << 20
#: Characters times candidates from which a text gets an automaton.
SCAN_LIMIT = 1 << 24
#: Characters of the keywords that are looked for by the hash of the whole keyword.
LONGEST = 64
#: Lengths at which a longer keyword's beginning must be known, too.
STEPS = (3, 4, 6, 8, 12, 16, 24, 32)
#: Bits of the bitmap, for a keyword and at most.
BITS_A_KEYWORD, MOST_BITS = 32, 1 << 29
#: Slots of first rules (12 bytes each), for a keyword and at most.
SLOTS_A_KEYWORD, MOST_SLOTS = 4, 1 << 23
#: Characters whose hashes a task holds at a time (or one text).
SLICE_CHARS = 1 << 20
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: Column, q: int) -> Column:
    """Hashes of the distinct pieces of ``q`` characters, in one pass over the text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % q), F.lit(1))), lambda p: F.xxhash64(p))


def all_pieces(df: DataFrame, text: str, sizes: list[int], *keep: str) -> DataFrame:
    """``(*keep, q, piece)`` of the texts for each of ``sizes``."""
    parts = [df.select(*keep, F.lit(q).alias("q"), F.explode(_pieces(F.col(text), q)).alias("piece")) for q in sizes]
    return reduce(DataFrame.unionByName, parts)


def distinct_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(keyword)``: the texts' distinct words between blanks, tabs and line feeds, in lower case."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()

        def flushed() -> pa.RecordBatch:
            held.discard("")
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["keyword"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch, batch.column(0)):
                for value in part.column(0).to_pylist():
                    held.update((value or "").replace("\t", " ").replace("\n", " ").split(" "))
                    if len(held) > HELD_WORDS:
                        yield flushed()
        yield flushed()

    ensure_shipped(texts.sparkSession)
    return texts.select(F.lower(text).alias("text")).mapInArrow(run, "keyword string").distinct()


def dictionary(rules_df: DataFrame, lower_keywords: bool = True) -> DataFrame:
    """``(keyword, rule)``: each keyword once, with its first rule (priority, label)."""
    keyword = F.lower("keyword") if lower_keywords else F.col("keyword")
    return rules_df.filter(F.col("keyword").isNotNull()).groupBy(keyword.alias("keyword")).agg(F.min(F.struct("priority", "label")).alias("rule"))


def anchors(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(q, piece, keyword, rule)``: the keywords of ``words`` (a stored table) that some text of ``texts``
    (column ``__text``) may contain, each with its anchor."""
    size = F.length("keyword")
    q = reduce(lambda c, n: c.when(size >= n, n), PIECES[1:], F.when(size >= PIECES[0], PIECES[0]))
    sized = words.filter(size > 0).withColumn("q", q)
    sizes = [r["q"] for r in sized.select("q").distinct().collect()]  # of PIECES
    if not sizes:
        return words.select(F.lit(0).alias("q"), F.lit(0).cast("long").alias("piece"), "keyword", "rule").limit(0)
    own = reduce(DataFrame.unionByName, [sized.filter(F.col("q") == n).select("keyword", "rule", "q", F.explode(_pieces(F.col("keyword"), n)).alias("piece")) for n in sizes])
    own = cut_lineage(own)
    wanted = bounded_broadcast(own.select("q", "piece").distinct(), BROADCAST_ROWS)
    seen = all_pieces(texts, "__text", sizes).join(wanted, ["q", "piece"], "left_semi").groupBy("q", "piece").agg(F.count(F.lit(1)).alias("n"))
    found = own.join(seen, ["q", "piece"], "left").groupBy("keyword", "rule", "q").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return cut_lineage(found.filter("least > 0").select("q", "piece", "keyword", "rule"))


def _first_contained(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The place of the first of the candidates that the text contains, or null."""
    import ahocorasick

    def first(text, keywords):
        if text is None or keywords is None:
            return None
        if len(text) * len(keywords) < SCAN_LIMIT:
            return next((i for i, k in enumerate(keywords) if k in text), None)
        automaton = ahocorasick.Automaton()
        for i, keyword in enumerate(keywords):
            automaton.add_word(keyword, i)
        automaton.make_automaton()
        return min((i for _, i in automaton.iter(text)), default=None)

    for texts, lists in columns:
        yield pd.Series([first(t, k) for t, k in zip(texts, lists, strict=True)], dtype="Int32")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[str]) -> np.ndarray:
    return _mix(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))


def _hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the rising ``sizes`` the hashes of all so many characters in a row."""
    rolled = codes
    for q in range(1, sizes[-1] + 1):
        if q > 1:
            if len(codes) < q:
                return
            rolled = rolled[:-1] * BASE + codes[q - 1:]
        if q in sizes:
            yield q, _mix(rolled + np.uint64(q))


def _slices(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts of about ``SLICE_CHARS`` characters; empty and null ones are left out."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield held


def _word_hashes(words: list[str], steps: tuple = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words' hashes, and those of the beginnings of ``steps`` characters of longer ones."""
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    whole, parts = np.zeros(len(words), np.uint64), []
    for q, h in _hashes(_codes(words), sorted({*lengths.tolist(), *steps})):
        own = np.flatnonzero(lengths == q)
        whole[own] = h[starts[own]]
        if q in steps:
            parts.append(h[starts[lengths > q]])
    return whole, parts


def _keyword_hashes(words: DataFrame) -> DataFrame:
    """``(id, hash)`` of the keywords."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, _ = _word_hashes(batch.column("keyword").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hashes.view(np.int64))], names=["id", "hash"])

    return words.select("id", "keyword").mapInArrow(run, "id long, hash long")


def _known(words: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes of the keywords and of their beginnings of ``STEPS`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                whole, parts = _word_hashes(batch.column("keyword").to_pylist(), STEPS)
                at = np.concatenate([whole, *parts]) & np.uint64(bits - 1)
                low, place = at & np.uint64(7), (at >> np.uint64(3)).astype(np.int64)
                for bit in range(8):
                    own = place[low == bit]
                    bitmap[own] |= np.uint8(1 << bit)
        yield pa.RecordBatch.from_arrays([pa.array([bitmap.tobytes()], pa.binary())], names=["bitmap"])

    few = words.select("keyword").coalesce(max(1, words.sparkSession.sparkContext.defaultParallelism))
    return few.mapInArrow(run, "bitmap binary").rdd.map(lambda r: np.frombuffer(r["bitmap"], np.uint8)).treeReduce(np.bitwise_or)


def _first_rules(own: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot (the uppermost bits of a hash) the least id of ``own`` there, 0 if there is none, and its hash."""
    slot = F.shiftrightunsigned("hash", 65 - slots.bit_length())
    rows = own.groupBy(slot.alias("slot")).agg(F.min("id").alias("id"), F.min_by("hash", "id").alias("hash")).toArrow()
    ids, hashes = np.zeros(slots, np.uint32 if len(rows) == 0 or rows.column("id").to_numpy().max() < 1 << 32 else np.uint64), np.zeros(slots, np.uint64)
    place = rows.column("slot").to_numpy()
    ids[place], hashes[place] = rows.column("id").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
    return ids, hashes


def _found(codes: np.ndarray, left: np.ndarray, bitmap: np.ndarray, lengths: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(at, hash)``: places where so many characters in a row, of one of ``lengths``, have a hash that the
    bitmap has. ``left`` are the characters to the text's end."""
    mask, alive, rolled = np.uint64(len(bitmap) * 8 - 1), np.arange(len(codes), dtype=np.int32), codes
    for q in range(1, max(lengths) + 1):  # alive: places whose beginnings are those of a keyword
        if q > 1:
            keep = np.flatnonzero(left[alive] >= q)
            alive = alive[keep]
            rolled = rolled[keep] * BASE + codes[alive + (q - 1)]
        if not len(alive):
            return
        if q not in lengths and q not in STEPS:
            continue
        got = _mix(rolled + np.uint64(q))
        bit = got & mask
        has = np.flatnonzero((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        if q in lengths:
            yield alive[has], got[has]
        if q in STEPS:
            alive, rolled = alive[has], rolled[has]


def _hash_hits(texts: DataFrame, known: np.ndarray, first: tuple[np.ndarray, np.ndarray], lengths: list[int]) -> DataFrame:
    """``(key, id, hash)``: of a text's substrings that the bitmap has, the least rule that the slots
    tell, and (with no id) the hashes, once each, that may have one before it."""
    held = texts.sparkSession.sparkContext.broadcast((known, *first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, ids, hashes = held.value
        shift, wanted, none = np.uint64(65 - len(ids).bit_length()), set(lengths), np.iinfo(np.int64).max
        for batch in batches:
            words, keys = batch.column("__text").to_pylist(), batch.column("__key")
            for places in _slices(words):
                part = [words[i] for i in places]
                size = np.array([len(t) for t in part])
                owner = np.repeat(np.arange(len(part), dtype=np.int32), size)
                left = (np.repeat(np.cumsum(size), size) - np.arange(size.sum())).astype(np.int32)
                best = np.full(len(part), none, np.int64)
                other, whose, least = [], [], []
                for at, got in _found(_codes(part), left, bitmap, wanted):
                    slot = (got >> shift).astype(np.int64)
                    id_, own = ids[slot].astype(np.int64), owner[at]
                    sure = hashes[slot] == got
                    known_ = np.flatnonzero(sure & (id_ > 0))
                    np.minimum.at(best, own[known_], id_[known_])
                    rest = np.flatnonzero(~sure & (id_ > 0))  # an empty slot has no keyword
                    rest = rest[id_[rest] < best[own[rest]]]
                    other.append(got[rest])
                    whose.append(own[rest])
                    least.append(id_[rest])
                rows = np.flatnonzero(best < none)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(places)[rows])), pa.array(best[rows]), pa.nulls(len(rows), pa.int64())], names=["key", "id", "hash"])
                if not other:
                    continue
                got, own, least = np.concatenate(other), np.concatenate(whose), np.concatenate(least)
                rest = np.flatnonzero(least < best[own])
                got, own = got[rest], own[rest]
                order = np.lexsort((got, own))
                got, own = got[order], own[order]
                once = np.concatenate(([True], (got[1:] != got[:-1]) | (own[1:] != own[:-1])))[:len(got)]
                got, own = got[once], own[once]
                for at in range(0, len(got), SLICE_CHARS):
                    rows = pa.array(np.array(places)[own[at : at + SLICE_CHARS]])
                    yield pa.RecordBatch.from_arrays([keys.take(rows), pa.nulls(len(rows), pa.int64()), pa.array(got[at : at + SLICE_CHARS].view(np.int64))], names=["key", "id", "hash"])

    return texts.select("__text", "__key").mapInArrow(run, "key binary, id long, hash long")


def _first_by_hash(texts: DataFrame, words: DataFrame, lengths: list[int], n: int) -> DataFrame:
    """``(__key, __word, __first)``: by hash, the first rule of ``words`` that a text contains."""
    numbered = cut_lineage(dense_sequence(words.select("rule.priority", "rule.label", "keyword", "rule"), ["priority", "label", "keyword"]))
    known = _known(numbered, 1 << min(MOST_BITS.bit_length() - 1, max(20, (n * BITS_A_KEYWORD).bit_length())))
    own = cut_lineage(_keyword_hashes(numbered))
    first = _first_rules(own, 1 << min(MOST_SLOTS.bit_length() - 1, max(10, (n * SLOTS_A_KEYWORD).bit_length())))
    hits = cut_lineage(_hash_hits(texts.filter("__text <> ''"), known, first, lengths))
    open_ = hits.filter("id IS NULL").select("key", "hash").join(bounded_broadcast(own, BROADCAST_ROWS), "hash").select("key", "id")
    found = hits.filter("id IS NOT NULL").select("key", "id").unionByName(open_).groupBy("key").agg(F.min("id").alias("id"))
    return cut_lineage(found.join(bounded_broadcast(numbered, BROADCAST_ROWS), "id")
                       .select(F.col("key").alias("__key"), F.col("keyword").alias("__word"), F.col("rule").alias("__first")))


def _first_by_pieces(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts`` with ``__rule``, the first rule of ``words`` that a text contains."""
    kept = [c for c in texts.columns]
    kind = words.schema["rule"].dataType
    look = anchors(texts, words)
    sizes = [r["q"] for r in look.select("q").distinct().collect()]  # of PIECES
    always = words.filter("keyword = ''").select("rule").first()  # one row at most
    held = F.lit(None).cast(kind)
    if always:
        held = F.when(F.col("__text").isNotNull(), F.struct(*[F.lit(always["rule"][f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]))
    if not sizes:
        return texts.withColumn("__rule", held)
    hits = all_pieces(texts, "__text", sizes, "__key").join(bounded_broadcast(look, BROADCAST_ROWS), ["q", "piece"]) \
        .select("__key", "rule", "keyword").distinct()
    lists = hits.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("rule", "keyword"))).alias("__rules"))
    joined = texts.join(lists, "__key", "left")
    place = F.pandas_udf(_first_contained, "int")(F.col("__text"), F.transform("__rules", lambda r: r["keyword"]))
    rule = F.get(F.col("__rules"), F.col("__place"))["rule"]
    return joined.withColumn("__place", place).select(*kept, F.least(rule, held).alias("__rule"))


def match_dictionary(df: DataFrame, rules_df: DataFrame, text_col: str = "text", lower_keywords: bool = True) -> DataFrame:
    """``df`` with ``rule_label``: the label of the first rule, by (priority, label), one of
    whose keywords the lower-cased text contains. Null if none does, or the text is null.
    An empty keyword is in every text; a null one in none."""
    ensure_shipped(df.sparkSession)
    words = cut_lineage(dictionary(rules_df, lower_keywords))  # read several times below
    names = [c for c in df.columns if c != "rule_label"]
    texts = df.withColumn("__text", F.lower(F.col(text_col))).withColumn("__key", F.unhex(F.md5("__text")))
    hashed = words.filter(F.length("keyword").between(1, LONGEST))
    sizes = hashed.agg(F.sort_array(F.collect_set(F.length("keyword"))).alias("lengths"), F.count(F.lit(1)).alias("n")).first()  # of 1 to LONGEST
    rest = words.filter((F.length("keyword") < 1) | (F.length("keyword") > LONGEST))
    if not sizes["n"]:
        return _first_by_pieces(texts, rest).select(*names, F.col("__rule")["label"].alias("rule_label"))
    best = _first_by_hash(texts.select("__text", "__key"), hashed, list(sizes["lengths"]), sizes["n"])
    met = texts.join(best, "__key", "left")
    sure = F.col("__word").isNull() | (F.instr("__text", F.col("__word")) > 0)
    columns = [*names, "__text", "__key"]
    out = met.filter(sure).select(*columns, "__first")
    other = met.filter(~sure).select(*columns)  # two hashes fell together
    if not other.isEmpty():
        out = out.unionByName(_first_by_pieces(other, hashed).withColumnRenamed("__rule", "__first"))
    if rest.isEmpty():
        return out.select(*names, F.col("__first")["label"].alias("rule_label"))
    return _first_by_pieces(out, rest).select(*names, F.least("__first", "__rule")["label"].alias("rule_label"))
