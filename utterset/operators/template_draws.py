"""Synthetic utterances from template and value tables, without repeats (GE-1, GE-2).

``generate`` draws each sample's template and values by hash, so samples repeat, and its
templates are literals. Here both come as tables of any size, and the samples of a label
are distinct combinations by construction:

1. Values are numbered within their slot, templates within their label. A template whose
   slots have n1, n2, ... values has n1 * n2 * ... combinations, numbered in mixed radix.
2. A label's samples are shared evenly among its templates; one with fewer combinations
   gives all of them, and the others share the rest. A label with fewer combinations than
   wanted samples gives each once.
3. Sample i of a template is combination (a i + b) mod n, where a is a prime that doesn't
   divide n and b is drawn by hash: a permutation, so no combination comes twice.
4. The digits of the combination join the value table once for each place of a slot.

Templates write a slot as ``{name}``. Values may hold braces: they are not filled again. A
template with a slot without values gives nothing; null templates and values are left
out, repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_u32, order_key
from ..session import cut_lineage
from .rank import bounded_broadcast, two_phase_rank

HOLE = r"\{([A-Za-z_]+)\}"
#: Primes for the permutation: the first that doesn't divide the number of combinations.
PRIMES = (2147483647, 2147483629)
#: Combinations a template may count; more are as good as these.
MOST = 10**18
#: Samples that are numbered in one row before they are spread.
BLOCK = 1 << 16
VALUE_ROWS = 1 << 20


def numbered_values(values: DataFrame, seed: int) -> DataFrame:
    """``(slot, val_idx, value)`` of the distinct values, numbered from 0 in a seeded order."""
    keyed = values.select("slot", "value").dropna().distinct().withColumn("__order", order_key(seed, "value"))
    return cut_lineage(two_phase_rank(keyed, "__order", ["slot"], tiebreak=["value"]).select("slot", (F.col("rank") - 1).alias("val_idx"), "value"))


def _whole(x) -> Column:
    return (F.col(x) if isinstance(x, str) else F.lit(x)).cast("decimal(38,0)")


def _product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("decimal(38,0)"), lambda a, n: F.least((a * n).cast("decimal(38,0)"), _whole(MOST)))


def numbered_templates(templates: DataFrame, values: DataFrame, seed: int) -> DataFrame:
    """``(label, tmpl_idx, template, slots, sizes, combinations)``; ``slots`` in the order of
    their first places."""
    sizes = values.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    own = templates.select("label", "template").dropna().distinct() \
        .withColumn("slots", F.array_distinct(F.regexp_extract_all("template", F.lit(HOLE), F.lit(1))))
    place = own.select("label", "template", F.posexplode("slots").alias("k", "slot")).join(bounded_broadcast(sizes), "slot", "left")
    counted = place.groupBy("label", "template").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    own = own.join(counted, ["label", "template"], "left") \
        .withColumn("sizes", F.coalesce(F.transform("s", lambda x: x["n"].cast("decimal(19,0)")), F.array().cast("array<decimal(19,0)>"))).drop("s")
    keyed = own.withColumn("combinations", _product(F.col("sizes"))).withColumn("__order", order_key(seed, "template"))
    ranked = two_phase_rank(keyed, "__order", ["label"], tiebreak=["template"])
    return cut_lineage(ranked.select("label", (F.col("rank") - 1).alias("tmpl_idx"), "template", "slots", "sizes", "combinations"))


def shares(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """``templates`` with ``draws``, their samples, and ``first``, the first of them.

    With sizes in rising order, a template's level is an even share of what the smaller
    ones leave. Below the first template that reaches its level all give what they have."""
    rising = Window.partitionBy("label").orderBy("combinations", "tmpl_idx")
    whole = Window.partitionBy("label")
    left = _whole("wanted") - F.coalesce(F.sum("combinations").over(rising.rowsBetween(Window.unboundedPreceding, -1)), _whole(0))
    others = F.count(F.lit(1)).over(whole) - F.row_number().over(rising) + 1
    df = templates.join(bounded_broadcast(wanted), "label").withColumn("left", left).withColumn("others", others.cast("decimal(38,0)"))
    short = F.col("combinations") * F.col("others") < F.col("left")
    # The first template that isn't short sets the level for itself and all larger ones.
    df = df.withColumn("at", F.when(~short, F.row_number().over(rising)))
    df = df.withColumn("start", F.min("at").over(whole)).withColumn("place", F.row_number().over(rising))
    level = F.max(F.when(F.col("place") == F.col("start"), F.struct("left", "others"))).over(whole)
    df = df.withColumn("level", level)
    even = F.call_function("div", F.col("level")["left"], F.col("level")["others"])
    extra = F.when(F.col("place") - F.col("start") < F.col("level")["left"] - even * F.col("level")["others"], 1).otherwise(0)
    draws = F.when(F.col("start").isNull() | (F.col("place") < F.col("start")), F.col("combinations").cast("long")).otherwise(even + extra)
    order = Window.partitionBy("label").orderBy("tmpl_idx").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("draws", draws.cast("long")).withColumn("first", F.coalesce(F.sum("draws").over(order), F.lit(0)).cast("long")) \
        .select(*templates.columns, "draws", "first")


def draw(templates: DataFrame, values: DataFrame, wanted: DataFrame, seed: int = 42) -> DataFrame:
    """``(label, sample_idx, tmpl_idx, text)``: ``wanted`` (label, wanted) distinct combinations of
    each label's ``templates`` (label, template) and the ``values`` (slot, value)."""
    values = numbered_values(values, seed)
    shared = cut_lineage(shares(numbered_templates(templates, values, seed), wanted)).filter("draws > 0")
    places = shared.agg(F.max(F.size("slots"))).first()[0] or 0
    a = F.when(F.col("combinations") % PRIMES[0] != 0, _whole(PRIMES[0])).otherwise(_whole(PRIMES[1]))
    b = hash_u32(seed, "label", "template", F.lit("start"))
    blocks = shared.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / BLOCK)))).repartition("label", "tmpl_idx", "block")
    low = F.col("block") * BLOCK
    rows = blocks.withColumn("i", F.explode(F.sequence(low, F.least(low + BLOCK, F.col("draws")) - 1)))
    rows = rows.withColumn("rest", ((_whole("i") * a + b) % F.col("combinations")).cast("decimal(38,0)"))
    held = bounded_broadcast(values, VALUE_ROWS)
    for k in range(places):
        n = F.get(F.col("sizes"), F.lit(k)).cast("decimal(38,0)")
        mine = held.select(F.col("slot").alias(f"s{k}"), F.col("val_idx").alias(f"d{k}"), F.col("value").alias(f"v{k}"))
        rows = rows.withColumn(f"s{k}", F.get(F.col("slots"), F.lit(k))).withColumn(f"d{k}", (F.col("rest") % n).cast("long")) \
            .withColumn("rest", F.coalesce(F.call_function("div", F.col("rest"), n).cast("decimal(38,0)"), F.col("rest")))
        rows = rows.join(mine, [f"s{k}", f"d{k}"], "left")
    holes = F.regexp_extract_all("template", F.lit(HOLE), F.lit(1))
    found = F.array(*[F.col(f"v{k}") for k in range(places)]) if places else F.array().cast("array<string>")
    filled = F.transform(holes, lambda h: F.element_at(found, F.array_position("slots", h).cast("int")))
    parts = F.arrays_zip(F.split("template", HOLE).alias("part"), filled.alias("value"))
    text = F.array_join(F.flatten(F.transform(parts, lambda x: F.array(x["part"], x["value"]))), "")  # no value after the last part
    return rows.select("label", (F.col("first") + F.col("i")).alias("sample_idx"), "tmpl_idx", text.alias("text"))
