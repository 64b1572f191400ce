"""Finding short texts inside long ones, with DataFrame functions only.

An item (license template, benchmark question) is in a document if the document holds
at least a share ``threshold`` of the item's distinct 5-word shingles, wherever they
stand: repeated words inside the item and insertions between its parts change nothing.

1. Sieve. Shingles that no item has can't take part in a match. Documents' shingles
   are exploded (only hash and position) and joined to the items' distinct hashes.
2. MinHash. What the sieve leaves of a document is a set; with ``windowed`` also that of
   each window of 2u positions that starts every u, for every u that is the power of two
   from an item's length in positions up, so that a passage lies in one window whole. Sets
   are partitioned by size, items too. A set of at most s shingles that holds an item of
   q or more has a similarity of j = t / (1 - t + s / q) or more with it, so that b bands of
   one minimum hash have one in common but for (1 - j)^b. b is chosen for each pair of
   sizes so that this is ``MISS`` at most. Where b bands would be more than the set's
   shingles, the shingles themselves are the bands, and nothing is missed.
3. Verification. The item's shingles in each candidate are counted exactly: in windows
   as above and in the whole document. The best window gives the place; where none
   reaches the threshold by itself, the whole document does.

Words are maximal runs of Unicode letters and digits in lower case. Items of fewer
than five words have their whole sequence as one shingle, which is looked for among
the documents' shingles of that length; items without words match nothing.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

WIDTH = 5
MISS = 1e-6
#: The whole document as a window; others are numbered from -1.
WHOLE = -2
#: Distinct item shingles (16 bytes each in a broadcast table) up to which they are broadcast.
BROADCAST_SHINGLES = 1 << 20


def word_list(text: str = "text") -> Column:
    parts = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")


def word_codes(text: str = "text") -> Column:
    """A hash of each word; shingles are hashed out of these."""
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def _hashes(codes: Column, width: int) -> Column:
    """Hashes of all ``width`` consecutive words, in order."""
    return F.when(F.size(codes) >= width, F.transform(
        F.sequence(F.lit(0), F.size(codes) - width), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(width)]))) \
        .otherwise(F.array().cast("array<bigint>"))


def band_count(threshold: float, set_size: int, item_size: int, miss: float = MISS) -> int:
    """Bands of one minimum hash with which a set of at most ``set_size`` shingles that holds
    a share ``threshold`` of an item's at least ``item_size`` is a candidate but for ``miss``."""
    least = threshold / (1 - threshold + max(set_size / item_size, threshold))
    return 1 if least >= 1 else ceil(log(miss) / log(1 - least))


def item_shingles(items: DataFrame, item_id: str, text: str = "text") -> DataFrame:
    """``(item, width, size, unit, h)``: an item's distinct shingle hashes, their number
    and the power of two from its length in shingle positions up, u. Rows that share an id
    with another text are items of their own."""
    words = items.select(F.struct(F.col(item_id), F.xxhash64(text).alias("h")).alias("item"), word_codes(text).alias("w")) \
        .filter(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    full = words.withColumn("h", F.array_distinct(F.when(F.col("width") == WIDTH, _hashes(F.col("w"), WIDTH)).when(F.col("width") == 1, _hashes(F.col("w"), 1)).when(F.col("width") == 2, _hashes(F.col("w"), 2))
                                                     .when(F.col("width") == 3, _hashes(F.col("w"), 3)).otherwise(_hashes(F.col("w"), 4))))
    unit = F.pow(F.lit(2), F.ceil(F.log2(F.size("w") - F.col("width") + 1))).cast("long")
    return full.select("item", "width", F.size("h").alias("size"), unit.alias("unit"), F.explode("h").alias("h")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _sieved_sets(hits: DataFrame, shingles: DataFrame, windowed: bool) -> DataFrame:
    """``(doc, width, unit, window, hs, s2)``: the distinct item shingles of whole documents
    (unit 0) and of windows, and the power of two from their number up."""
    whole = hits.select("doc", "width", F.lit(0).cast("long").alias("unit"), F.lit(WHOLE).cast("long").alias("window"), "h")
    if windowed:
        units = F.broadcast(shingles.select("width", "unit").distinct())  # one row a width and power of two
        block = F.floor(F.col("pos") / F.col("unit"))
        windows = hits.join(units, "width").select("doc", "width", "unit", F.explode(F.array(block - 1, block)).alias("window"), "h")
        whole = whole.union(windows)
    sets = whole.groupBy("doc", "width", "unit", "window").agg(F.collect_set("h").alias("hs"))
    return sets.withColumn("s2", F.pow(F.lit(2), F.ceil(F.log2(F.size("hs")))).cast("long"))


def candidates(hits: DataFrame, shingles: DataFrame, threshold: float, windowed: bool, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``(doc, item)`` pairs that MinHash bands retrieve."""
    sets = stored(_sieved_sets(hits, shingles, windowed), "sets")
    half = F.pow(F.lit(2), F.floor(F.log2("size"))).cast("long")  # an item's size, rounded down
    sized = shingles.withColumn("q", half)
    kinds = sized.select("width", "unit", "q").distinct().collect()  # powers of two: a few hundred at most
    used = sets.select("width", "unit", "s2").distinct().collect()
    plan = []
    for u in used:
        q = [k["q"] for k in kinds if k["width"] == u["width"] and u["unit"] in (0, k["unit"]) and threshold * k["q"] <= u["s2"]]
        if q:
            plan.append((u["width"], u["unit"], u["s2"], max(band_count(threshold, u["s2"], x) for x in q)))
    spark = hits.sparkSession
    bands = spark.createDataFrame(plan, "width int, unit long, s2 long, bands int")
    hashed = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda i: F.struct(i.alias("i"), F.array_min(F.transform("hs", lambda h: F.xxhash64(h, i))).alias("v")))
    plain = F.transform("hs", lambda h: F.struct(F.lit(-1).alias("i"), h.alias("v")))
    keys = sets.join(F.broadcast(bands), ["width", "unit", "s2"]) \
        .select("doc", "width", "unit", F.explode(F.when(F.size("hs") <= F.col("bands"), plain).otherwise(hashed)).alias("k")) \
        .select("doc", "width", "unit", "k.i", "k.v")
    most = {}
    for width, unit, s2, n in plan:
        if n < s2:  # sets of this size may have more shingles than bands
            most[width, unit] = max(n, most.get((width, unit), 0))
    needs = spark.createDataFrame([(w, u, most.get((w, u), 0)) for w, u in {(p[0], p[1]) for p in plan}], "width int, unit long, bands int")
    own = shingles.groupBy("item", "width", "unit").agg(F.collect_set("h").alias("hs"))
    own = own.union(own.withColumn("unit", F.lit(0).cast("long"))).distinct().join(F.broadcast(needs), ["width", "unit"])
    some = F.when(F.col("bands") > 0, hashed).otherwise(F.array().cast("array<struct<i:int,v:bigint>>"))
    offers = own.select("item", "width", "unit", F.explode(F.concat(plain, some)).alias("k")).select("item", "width", "unit", "k.i", "k.v")
    return keys.join(_small(stored(offers, "bands"), broadcast_shingles), ["width", "unit", "i", "v"]).select("doc", "item").distinct()


def contained_rows(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, threshold: float = 0.75, windowed: bool = False,
                   broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``(doc, item_id, containment, first_word, last_word)`` as ``contained`` gives it, where
    ``doc`` is a struct of the document's id and ``h``, the hash of its text."""
    shingles = stored(item_shingles(items, item_id), "items")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # five values at most
    key = F.struct(F.col(doc_id), F.xxhash64("text").alias("h")).alias("doc")
    words = docs.select(key, word_codes().alias("w"))
    wanted = shingles.select("width", "h").distinct()
    hits = None
    for width in widths:
        rows = words.select("doc", F.posexplode(_hashes(F.col("w"), width)).alias("pos", "h"))
        found = rows.join(_small(wanted.filter(F.col("width") == width).select("h"), broadcast_shingles), "h") \
            .withColumn("width", F.lit(width))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.join(items.select(item_id), F.lit(False)).select(
            key, item_id, F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).alias("last_word"))
    hits = stored(hits.distinct(), "hits")
    pairs = candidates(hits, shingles, threshold, windowed, broadcast_shingles)

    # Each hit lies in the window that starts at its u-block, in the one before and in the whole document.
    found = pairs.join(shingles, "item").join(hits, ["doc", "width", "h"])
    block = F.floor(F.col("pos") / F.col("unit"))
    shared = found.withColumn("window", F.explode(F.array(block - 1, block, F.lit(WHOLE)))) \
        .groupBy("doc", "item", "window", "size").agg(F.count_distinct("h").alias("n"), F.min("pos").alias("first_word"), F.max(F.col("pos") + F.col("width") - 1).alias("last_word")) \
        .withColumn("containment", F.col("n") / F.col("size")).filter(F.col("containment") >= threshold)
    best = F.min_by(F.struct("containment", "first_word", "last_word"), F.struct(F.col("window") == WHOLE, -F.col("containment"), F.col("window")))
    return shared.groupBy("doc", F.col("item")[item_id].alias(item_id)).agg(best.alias("best")).select("doc", item_id, "best.*")


def contained(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, threshold: float = 0.75, windowed: bool = False,
              broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``(doc_id, item_id, containment, first_word, last_word)``: for every document and
    item of which it holds at least ``threshold`` of the distinct shingles, the best
    window's containment and the (0-based) words its shingles span; of equally good windows
    the earliest, and the whole document where no window reaches ``threshold``. Rows of
    one ``doc_id`` with different texts are searched apart; the best one's place is given."""
    found = contained_rows(docs, items, doc_id, item_id, threshold, windowed, broadcast_shingles)
    best = F.max_by(F.struct("containment", "first_word", "last_word"), F.struct("containment", -F.col("first_word"), -F.col("last_word")))
    return found.groupBy(F.col(f"doc.{doc_id}").alias(doc_id), item_id).agg(best.alias("best")).select(doc_id, item_id, "best.*")
