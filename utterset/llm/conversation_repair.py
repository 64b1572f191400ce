"""Conversation structure repair by a persistent audit programme.

1. Equal rows of a conversation become one row with a count; rows are dealt to ordered
   ranges of (conversation, turn, role, text), so that a conversation of any size
   spreads over many tasks, and cut into segments of bounded rows and bytes.
2. A conversation in one segment (nearly all) is finished there. The others' segments
   find repeated rows by an aggregation of the first places of (conversation, role,
   text), and each solves the programme of ``trails`` from every state it may be entered in.
3. Segments of one conversation are then chained in order: sixteen (cost, audit) pairs a
   segment instead of its rows. Ties compare linked segment audits.
4. Each segment applies its part of the audit. A digest of a whole conversation can only
   be taken in order; it reads the repaired segments as a stream, one at a time.

Faults, the first of which counts: blank (only the six ASCII blanks), duplicate (role
and text seen earlier in the conversation), truncated (the last other character is none
of ``.!?``). Blank and duplicate rows go.

Edge cases: null roles and texts count as one space; a null ``conv_id`` is a conversation
of its own; null turns come first and take no part in the gaps; rows of one turn come in
the order of role, then text (by code points); an empty role can't be kept as it is; an
empty table gives empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trails
from .tables import stored
from .trails import Row, Trail

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
#: Rows (with their repeats) and characters after which a segment is closed.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 20
ORDER = ("conv_id", "turn", "role", "text", "part")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: the rows after faults drawn by their key."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their ``copies``, at most ``SEGMENT_ROWS`` to a row, in order."""
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SEGMENT_ROWS))).alias("part")
    cut = alike.select("*", part).withColumn("copies", F.least(F.lit(SEGMENT_ROWS), F.col("copies") - F.col("part") * SEGMENT_ROWS))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)


def _segments(rows: DataFrame) -> DataFrame:
    """``(seg, conv_id, whole, turns, roles, texts, copies)``; ``seg`` follows the order, and
    ``whole`` tells that the segment is known to be its whole conversation."""
    schema = T.StructType([T.StructField("seg", T.LongType()), rows.schema["conv_id"], *T.StructType.fromDDL(
        "whole boolean, turns array<long>, roles array<string>, texts array<string>, copies array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 33
        types, ready, chars_ready = None, [], 0
        held, chars, n, opened = [], 0, 0, False  # opened: the segment is known to begin its conversation

        def close(ended: bool):
            nonlocal held, chars, n, seg, opened, chars_ready
            ready.append((seg, held[0][0], opened and ended, *([r[k] for r in held] for k in (1, 2, 3, 4))))
            seg, chars_ready = seg + 1, chars_ready + chars
            held, chars, n, opened = [], 0, 0, ended

        def output():
            nonlocal ready, chars_ready
            columns = [pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)]
            ready, chars_ready = [], 0
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            types = [pa.int64(), kind, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")), strict=True):
                if held and held[0][0] != row[0]:
                    close(True)
                elif held and (n + row[4] > SEGMENT_ROWS or chars + len(row[3]) > SEGMENT_CHARS):
                    close(False)
                held.append(row)
                chars, n = chars + len(row[2]) + len(row[3]), n + row[4]
                if len(ready) >= SEGMENT_ROWS or chars_ready >= SEGMENT_CHARS:
                    yield output()
        if held:
            close(False)
        if ready:
            yield output()

    return rows.mapInArrow(run, schema)


def _first_places(parts: DataFrame) -> DataFrame:
    """``(seg, firsts)``: which rows of a segment are the first of their role and text in
    the conversation."""
    row = F.explode(F.arrays_zip("roles", "texts", F.sequence(F.lit(0), F.size("roles") - 1).alias("i"))).alias("r")
    place = F.struct("seg", F.col("r.i").alias("i"))
    digest = F.sha2(F.concat(F.length("r.roles").cast("string"), F.lit(":"), F.col("r.roles"), F.col("r.texts")), 256)
    first = parts.select("conv_id", "seg", row).groupBy("conv_id", digest.alias("digest")).agg(F.min(place).alias("first"))
    return first.groupBy(F.col("first.seg").alias("seg")).agg(F.collect_list("first.i").alias("firsts"))  # a segment's rows at most


def judged(roles: list[str], texts: list[str], copies: list[int], firsts: set[int] | None) -> tuple[list[Row], list[tuple[str, str]], dict]:
    """The rows with repeats, their faults for the programme, and counts. ``firsts`` are the
    rows that don't repeat an earlier one; None: found among these rows themselves."""
    seen, rows, plain, counts = set(), [], [], dict.fromkeys(COUNTS, 0)
    for i, (role, text, n) in enumerate(zip(roles, texts, copies, strict=True)):
        body = text.rstrip(BLANKS)
        again = (role, text) in seen if firsts is None else i not in firsts
        seen.add((role, text))
        for k in range(n):
            fault = "blank" if not body else "duplicate" if again or k else "truncated" if body[-1] not in ENDINGS else None
            if fault:
                counts[fault] += 1
            if plain and plain[-1][0][:1] + role[:1] not in LEGAL:
                counts["illegal"] += 1
            plain.append((role, text))
            rows.append(Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return rows, plain, counts


STATS = "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, n_turns long, first_turn long, last_turn long"


def _stats(plain: list[tuple[str, str]], counts: dict, turns: list[int | None]) -> tuple:
    known = [t for t in turns if t is not None]
    return (*(counts[c] for c in COUNTS), plain[0][0][:1], plain[-1][0][:1], len(set(known)), known[0] if known else None, known[-1] if known else None)


def _rows_of(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _mapped(df: DataFrame, schema: T.StructType, function, *names: str) -> DataFrame:
    """``function`` of each row's columns ``names`` gives one row of ``schema``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = [function(*row) for row in _rows_of(batch, *names)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _with_id(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("seg", T.LongType()), df.schema["conv_id"], *T.StructType.fromDDL(ddl).fields])


LINES = "lines array<struct<role:string,text:string,edit:string>>"


def _whole(segments: DataFrame) -> DataFrame:
    """Conversations of one segment: counts, cost, audit and repaired lines."""
    def solve(seg, conv_id, turns, roles, texts, copies):
        rows, plain, counts = judged(roles, texts, copies, None)
        cost, trail = trails.finish(trails.advance(trails.start(), rows))
        audit = trail.text()
        return (seg, conv_id, *_stats(plain, counts, turns), cost, audit, trails.edited(plain, audit)[0])

    return _mapped(segments.filter("whole"), _with_id(segments, f"{STATS}, cost long, audit string, {LINES}"), solve,
                   "seg", "conv_id", "turns", "roles", "texts", "copies")


def _in_order(df: DataFrame) -> DataFrame:
    """A conversation's segments after one another in one task, as a stream."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "seg")


def _chained(solved: DataFrame) -> DataFrame:
    """``(seg, entry, price, edits)``: the state in which the cheapest edits of the whole
    conversation enter each segment, and the segment's own part of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states, entries = None, None, None

        def chosen():
            _, trail = trails.finish(states)
            path = [entries[node] for node in trail.nodes() if node in entries]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*path, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                              names=["seg", "entry", "price", "edits"])

        for batch in batches:
            for seg, conv_id, ways in _rows_of(batch, "seg", "conv_id", "ways"):
                if current is None or current[0] != conv_id:
                    if current is not None:
                        yield chosen()
                    current, states, entries = (conv_id,), trails.start(), {}
                first, found = not entries, [None] * 4
                for way in ways:
                    held = states[way["entry"]]
                    if held is None:
                        continue
                    new = (held[0] + way["cost"], Trail(held[1], way["audit"]))
                    if trails.better(new, found[way["exit"]]):
                        found[way["exit"]] = new
                        before = held[1].text() if first else ""  # inserts before the first row
                        entries[new[1]] = (seg, 0 if first else way["entry"], way["cost"] + trails.INSERT * len(before), before + way["audit"])
                states = found
        if current is not None:
            yield chosen()

    return _in_order(solved).mapInArrow(run, "seg long, entry long, price long, edits string")


def _parts(segments: DataFrame) -> DataFrame:
    """Conversations of several segments, in the form of ``_whole``, one row a segment."""
    parts = segments.filter("not whole")
    judged_parts = stored(parts.join(_first_places(parts), "seg", "left"), "parts")

    def ways(seg, conv_id, roles, texts, copies, firsts):
        rows, _, _ = judged(roles, texts, copies, set(firsts or ()))
        out = []
        for entry in range(4):
            for exit_, held in enumerate(trails.advance(trails.entered(entry), rows)):
                if held is not None:
                    out.append((entry, exit_, held[0], held[1].text()))
        return seg, conv_id, out

    solved = _mapped(judged_parts, _with_id(segments, "ways array<struct<entry:int,exit:int,cost:long,audit:string>>"), ways,
                     "seg", "conv_id", "roles", "texts", "copies", "firsts")
    chosen = stored(_chained(solved), "edits")

    def apply(seg, conv_id, turns, roles, texts, copies, firsts, entry, price, edits):
        _, plain, counts = judged(roles, texts, copies, set(firsts or ()))
        return (seg, conv_id, *_stats(plain, counts, turns), price, edits, trails.edited(plain, edits, entry)[0])

    return _mapped(judged_parts.join(chosen, "seg"), _with_id(segments, f"{STATS}, cost long, audit string, {LINES}"), apply,
                   "seg", "conv_id", "turns", "roles", "texts", "copies", "firsts", "entry", "price", "edits")


def repair(rows: DataFrame) -> DataFrame:
    """``(seg, conv_id, whole, <counts>, cost, audit, lines)`` of ``rows`` (conv_id, turn, role,
    text and, if rows are repeated, copies): the repaired conversations, segment by
    segment in the order of ``seg``. ``lines`` has the role, text and edit of each row left."""
    if "copies" not in rows.columns:
        rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))
    segments = stored(_segments(_ordered(rows)), "segments")
    whole = _whole(segments).withColumn("whole", F.lit(True))
    return stored(whole.unionByName(_parts(segments).withColumn("whole", F.lit(False))), "repaired")


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """``(conv_id, seg, place, role, text, edit)``: the rows that ``repair`` leaves; in the
    order of (seg, place)."""
    return repaired.select("conv_id", "seg", F.posexplode("lines").alias("place", "line")).select("conv_id", "seg", "place", "line.*")


def report(repaired: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``conv_ids``: gaps, counts, cost, audit and the SHA-256
    of the repaired ``role:text`` lines."""
    body = F.array_join(F.transform("lines", lambda line: F.concat(line["role"], F.lit(":"), line["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    whole = repaired.filter("whole").select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", F.sha2(body, 256).alias("repaired_sha256"))
    parts = repaired.filter("not whole").withColumn("body", body).withColumn("n_lines", F.size("lines")).drop("lines", "whole")
    names = ("conv_id", *COUNTS, "first_initial", "last_initial", "n_turns", "first_turn", "last_turn", "cost", "audit", "body", "n_lines")
    given = whole.columns

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def output():
            spread = now["last"] - now["first"] + 1 - now["turns"] if now["first"] is not None else 0
            values = [now["conv_id"], spread, *(now[c] for c in COUNTS), now["cost"], "".join(now["audit"]), now["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=given)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for values in _rows_of(batch, *names):
                row = dict(zip(names, values, strict=True))
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        yield output()
                    now = {"conv_id": row["conv_id"], **dict.fromkeys(COUNTS, 0), "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0,
                           "initial": None, "first": None, "last": None, "turns": 0}
                for c in (*COUNTS, "cost"):
                    now[c] += row[c]
                if now["initial"] is not None and now["initial"] + row["first_initial"] not in LEGAL:
                    now["illegal"] += 1
                now["initial"] = row["last_initial"]
                if row["first_turn"] is not None:
                    now["turns"] += row["n_turns"] - (now["last"] == row["first_turn"])
                    now["first"], now["last"] = row["first_turn"] if now["first"] is None else now["first"], row["last_turn"]
                now["audit"].append(row["audit"])
                if row["n_lines"]:
                    now["sha"].update(("\n" if now["lines"] else "").encode() + row["body"].encode())
                    now["lines"] += row["n_lines"]
        if now is not None:
            yield output()

    long = whole.unionByName(_in_order(parts).mapInArrow(combine, whole.schema)).withColumnRenamed("conv_id", "own_id")
    ids = conv_ids.select("conv_id").distinct()
    joined = ids.join(long, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    zero = {c: 0 for c in ("gaps", *COUNTS, "cost")}
    return joined.fillna({**zero, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
