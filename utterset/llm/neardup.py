"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text's set of distinct 5-word shingles becomes a digest and a signature of
   240 minimum hashes. Texts of one digest are one class, so exact copies meet in one
   pre-aggregated group and go on as a single row.
2. Banding (48 bands of 5): with similarity 0.75 a pair shares no band with
   probability (1 - 0.75^5)^48 = 2e-6. First, in two of the bands, every member of a
   bucket is paired with the bucket's smallest member; exact links make classes. Then,
   in all bands, only buckets with members of two classes or more are still open; the
   smallest members of their classes are paired with that of the first class.
3. Verification compares signatures 16 hashes at a time and drops a pair when the
   posterior probability (uniform prior) that its similarity reaches the threshold
   falls below ``MISS``; survivors are compared exactly on their full sets.
4. A bucket that is open even then may hide a link between members that are not the
   smallest of their classes. The members of an open bucket are compared by signature,
   block by block, inside the tasks; one that may reach the threshold with a member of a
   larger class is that class's guest. Guests are compared with all of the host's
   members, again block by block: signatures first, then the survivors' full sets. One
   link to a host joins the guest's class to it, so a guest reports one at most. All
   pairs in a bucket but those within a class are compared; none is capped or dropped.
5. Components of the exact links give each text its class.

Edge cases: texts without words (null, empty, blanks) have an empty set, 0 shingles
and no link; repeated rows are members of one class; rows with a null ``doc_id`` take
part and never name a class unless all of the class have none. ``doc_id`` need not be
unique. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import stored, widened, without
from .wordops import packed, shingle_sets, slices, word_hashes

WIDTH = 5
HASHES, BANDS, BATCH = 240, 48, 16
FIRST_BANDS = 2
MISS = 1e-6
#: Host members, or guests, and their shingles that meet in one group of step 4.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
#: Pairs of signatures that a task holds at a time in step 4.
PAIRS = 1 << 16
_RNG = np.random.default_rng(731)
FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
SHIFTS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum hashes (uint32) of each non-empty set, one row a set."""
    some = np.diff(offsets) > 0
    starts = offsets[:-1][some]
    out = np.zeros((len(some), HASHES), np.uint32)
    for k in range(HASHES if len(starts) else 0):
        value = ((flat * FACTORS[k] + SHIFTS[k]) >> np.uint64(32)).astype(np.uint32)
        out[some, k] = np.minimum.reduceat(value, starts)
    return out


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 16, 32, ... compared hashes the fewest matches with which the posterior
    probability of a similarity of ``threshold`` or more is at least ``miss``.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), so
    P(s >= t) = P(Binomial(n+1, t) <= m)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` but with ``n_shingles``, ``digest`` (null for an
    empty set) and ``signature``."""
    docs = without(docs, "n_shingles", "digest", "signature")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, offsets = shingle_sets(word_hashes(part.column("text"), lower=True), WIDTH)
                size = np.diff(offsets)
                digest = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) if b > a else None for a, b in zip(offsets, offsets[1:])]
                sign = signatures(flat, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(size), pa.array(digest, pa.binary()),
                     packed(sign.ravel(), np.arange(len(size) + 1) * HASHES)], names=[*names, "n_shingles", "digest", "signature"])

    return docs.mapInArrow(run, widened(docs.drop("text"), n_shingles="long", digest="binary", signature="binary"))


def _pairs_with_signatures(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    one = reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    return pairs.join(one, "a").join(two, "b")


def compare(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) that may reach the threshold, by their signatures."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (_matrix(batch.column(c)) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            maybe, match = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9, np.zeros(len(sa), np.int64)
            for step, low in enumerate(least):
                left = np.flatnonzero(maybe)
                cols = slice(step * BATCH, (step + 1) * BATCH)
                match[left] += (sa[left, cols] == sb[left, cols]).sum(axis=1)
                maybe &= match >= low
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(maybe))

    return _pairs_with_signatures(pairs, reps).select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a binary, b binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _survivors(host: np.ndarray, guest: np.ndarray, least: list[int]) -> np.ndarray:
    """Host rows that may reach the threshold with one guest's signature."""
    rows, match = np.arange(len(host)), np.zeros(len(host), np.int64)
    for step, low in enumerate(least):
        cols = slice(step * BATCH, (step + 1) * BATCH)
        match = match + (host[rows, cols] == guest[cols]).sum(axis=1)
        keep = match >= low
        rows, match = rows[keep], match[keep]
        if not len(rows):
            break
    return rows


def full_sets(names: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(rep, items)``: the sorted shingle hashes of the digests ``names`` (rep)."""
    need = stored(names.distinct().join(reps.select("rep", "id"), "rep"), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, offsets = shingle_sets(word_hashes(part.column("text"), lower=True), WIDTH)
                digest = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), packed(flat, offsets)], names=["rep", "items"])

    # Texts by the class's first doc_id; a row of that id with another text drops out by its digest.
    rows = docs.select("doc_id", "text").join(need.select(F.col("id").alias("own")).distinct(), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    found = rows.mapInArrow(sets, "rep binary, items binary").join(need.select("rep"), "rep", "left_semi")
    return stored(found.dropDuplicates(["rep"]), "sets")


def exact_links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) of digests with 100 * intersection >= 100 t * union of their full sets."""
    percent = round(100 * threshold)
    held = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")), docs, reps)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(held.select(F.col("rep").alias("a"), F.col("items").alias("xa")), "a") \
        .join(held.select(F.col("rep").alias("b"), F.col("items").alias("xb")), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(check, "a binary, b binary")


def _star(members: DataFrame) -> DataFrame:
    """Pairs of each member ``m`` of a bucket with the bucket's smallest."""
    lead = members.groupBy("key").agg(F.min("m").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(lead, "key").filter("m <> a").select("a", F.col("m").alias("b"))


def _classed(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``members`` with their ``class`` by now and its ``size``."""
    classes = components(links)
    size = classes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    known = stored(classes.join(size, "component"), name)
    return members.drop("class", "size").join(known.withColumnRenamed("node", "m"), "m", "left") \
        .withColumn("class", F.coalesce("component", "m")).withColumn("size", F.coalesce("size", F.lit(1))).drop("component")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold two classes or more."""
    mixed = members.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
    return stored(members.join(mixed, "key"), "open")


def _guests(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``(host, host_size, m)``: each member of an open bucket with each larger class
    there (of equally large ones the one with the larger id) in which some member's
    signature may reach the threshold with its own. A bucket's members are compared in
    blocks inside the tasks; only what passes becomes a row."""
    least = least_matches(threshold)
    size = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "key").join(reps.select(F.col("rep").alias("m"), "n_shingles", "signature"), "m") \
        .withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "block", "m", "class", "size", "n_shingles", "signature")

    def run(group: pa.Table) -> pa.Table:
        names, owner, sizes = (group.column(c).to_pylist() for c in ("m", "class", "size"))
        order = sorted(range(len(names)), key=lambda r: (sizes[r], owner[r]))
        new = [k == 0 or owner[order[k]] != owner[order[k - 1]] for k in range(len(order))]
        rank, sign = np.cumsum(new), _matrix(group.column("signature"))[order]
        block, n = (group.column(c).to_numpy()[order] for c in ("block", "n_shingles"))
        apart = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        ends = np.searchsorted(rank, rank, side="right")
        step, found = max(1, PAIRS // len(order)), []
        for at in range(0, len(order), step):
            start = ends[at : at + step]
            counts = len(order) - start
            x = np.repeat(np.arange(at, at + len(start)), counts)
            y = np.arange(counts.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
            some = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
            if apart:
                some &= block[x] != block[y]
            x, y = x[some], y[some]
            match = np.zeros(len(x), np.int64)
            for batch, low in enumerate(least):
                cols = slice(batch * BATCH, (batch + 1) * BATCH)
                match += (sign[x, cols] == sign[y, cols]).sum(axis=1)
                keep = match >= low
                x, y, match = x[keep], y[keep], match[keep]
            found.append(np.unique(np.stack([x, ends[y] - 1]), axis=1))  # a class by its last member
        x, y = np.concatenate(found, axis=1)
        return pa.table({"host": pa.array([owner[order[k]] for k in y], pa.binary()), "host_size": pa.array([sizes[order[k]] for k in y], pa.int64()),
                         "m": pa.array([names[order[k]] for k in x], pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "host binary, host_size long, m binary").distinct()


def _blocked(hosts: DataFrame, guests: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: for each guest and block of its host's members a link, if there is one.
    Both sides: (host, rep, n_shingles, signature, items)."""
    least, percent = least_matches(threshold), round(100 * threshold)

    def blocks(df, name):
        n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        size = df.groupBy("host").agg(n.alias(f"{name}s"))
        return df.join(size, "host").withColumn(name, F.pmod(F.xxhash64("rep"), F.col(f"{name}s")).cast("int"))

    h, g = blocks(hosts, "hb"), blocks(guests, "gb")
    n_hosts, n_guests = h.select("host", "hbs").distinct(), g.select("host", "gbs").distinct()
    h = h.join(n_guests, "host").withColumn("gb", F.explode(F.sequence(F.lit(0), F.col("gbs") - 1)))
    g = g.join(n_hosts, "host").withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("hbs") - 1)))

    def side(df, name):
        columns = {c: f"{name}_{c}" for c in ("host", "hb", "gb", "rep", "signature", "items")}
        return df.select([F.col(c).alias(n) for c, n in columns.items()]).groupBy([columns[c] for c in ("host", "hb", "gb")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high = [], []
        if left.num_rows and right.num_rows:
            matrix, names = _matrix(left.column("h_signature")), left.column("h_rep").to_pylist()
            own = [np.frombuffer(x, "<u8") for x in left.column("h_items").to_pylist()]
            size = np.array([len(x) for x in own])
            starts = np.concatenate(([0], np.cumsum(size)))[:-1]
            known, code = np.unique(np.concatenate(own), return_inverse=True)
            mark = np.zeros(len(known), np.int32)
            guests_ = zip(right.column("g_rep").to_pylist(), _matrix(right.column("g_signature")), right.column("g_items").to_pylist(), strict=True)
            for rep, sign, items in guests_:
                rows = _survivors(matrix, sign, least)
                if not len(rows):
                    continue
                mine = np.frombuffer(items, "<u8")
                at = np.searchsorted(known, mine).clip(max=len(known) - 1)
                at = at[known[at] == mine]
                mark[at] = 1
                both = np.add.reduceat(mark[code], starts)[rows]
                mark[at] = 0
                linked = rows[100 * both >= percent * (size[rows] + len(mine) - both)]
                if len(linked):
                    low.append(min(rep, names[linked[0]]))
                    high.append(max(rep, names[linked[0]]))
        return pa.table({"a": pa.array(low, pa.binary()), "b": pa.array(high, pa.binary())})

    return side(h, "h").cogroup(side(g, "g")).applyInArrow(run, "a binary, b binary")


def near_duplicate_links(docs: DataFrame, sketched: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Links (a, b) between set digests whose components are those of all links."""
    sized = sketched.filter("digest is not null")
    reps = stored(sized.groupBy(F.col("digest").alias("rep")).agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "reps")
    width = 4 * HASHES // BANDS
    keys = "transform(sequence({}, {}), i -> xxhash64(i, substring(signature, i * %d + 1, %d)))" % (width, width)

    def verified(pairs, name):
        pairs = stored(compare(pairs.distinct(), reps, threshold), name)
        return exact_links(pairs, docs, reps, threshold)

    first = reps.select(F.col("rep").alias("m"), F.explode(F.expr(keys.format(0, FIRST_BANDS - 1))).alias("key"))
    links = stored(verified(_star(first), "first"), "links")
    members = _classed(reps.select(F.col("rep").alias("m"), "signature"), links, "known")
    members = _open(members.select("m", "class", "size", F.explode(F.expr(keys.format(0, BANDS - 1))).alias("key")))
    lead = _star(members.groupBy("key", "class").agg(F.min("m").alias("m")).select("key", "m"))
    links = stored(links.union(verified(lead, "second")), "links")

    members = _open(_classed(members, links, "known"))
    guests = stored(_guests(members, reps, threshold), "guests")
    alone = guests.filter("host_size = 1").select(F.least("host", "m").alias("a"), F.greatest("host", "m").alias("b"))
    visits = guests.filter("host_size > 1").select("host", F.col("m").alias("rep"))
    hosts = stored(components(links).select(F.col("node").alias("rep"), F.col("component").alias("host"))
                   .join(visits.select("host").distinct(), "host"), "hosts")
    whole = reps.select("rep", "n_shingles", "signature").join(full_sets(hosts.select("rep").union(visits.select("rep")), docs, reps), "rep")
    found = _blocked(hosts.join(whole, "rep"), visits.join(whole, "rep"), threshold)
    return stored(links.union(verified(alone, "alone")).union(found), "links")


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``docs`` (without ``text``) with ``n_shingles``, ``component_id`` (the smallest
    ``doc_id`` reachable by links, the row itself included) and ``kept``: it is that
    document. Of several rows with the kept id all are kept."""
    sketched = stored(sketch(without(docs, "component_id", "kept")), "sketch")
    links = near_duplicate_links(docs, sketched, threshold)
    classes = components(links)
    ids = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    ids = ids.join(classes.withColumnRenamed("node", "digest"), "digest", "left") \
        .select("digest", "id", F.coalesce("component", "digest").alias("component"))
    best = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    ids = stored(ids.join(best, "component").select("digest", "component_id"), "classes")
    out = sketched.drop("signature").join(ids, "digest", "left").drop("digest")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
