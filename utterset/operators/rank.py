"""Exact dense ranks without an un-partitioned (single-task) window.

``row_number().over(Window.partitionBy(label).orderBy(key))`` runs one task per
label; with a handful of labels, or one label holding a third of all rows, that
is one giant sort. Instead (two phases):

1. bucket every row by the leading hex digits of its (uniform) hash order key;
2. count rows per (partition keys, bucket) -- a partial aggregate, tiny output;
3. exclusive running sum of those counts per partition key = bucket offset;
4. rank = offset + row_number() within (partition keys, bucket).

Step 4's window has ``16^digits`` times as many groups as the plain one, so a
hot label spreads over thousands of tasks. The offsets table has at most
``n_keys * 16^digits`` rows; it is broadcast only below a checked row bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..session import cut_lineage

BROADCAST_ROW_LIMIT = 2_000_000


def _bucket(order_col: str, digits: int):
    return F.conv(F.substring(F.col(order_col), 1, digits), 16, 10).cast("int")


def bounded_broadcast(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only if its row count is proven below ``row_limit``.

    The count is one cheap job over an already small (aggregated) input; above
    the limit the caller's join stays a shuffle join that AQE plans at runtime.
    """
    n = df.limit(row_limit + 1).count()
    return F.broadcast(df) if n <= row_limit else df


def small_table(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Materialise a table that is small by construction (one row per label,
    per label and bucket, ...) once in the shared checkpoint folder, then
    broadcast it if its checked size allows. Without this, the size check and
    the consuming join would each recompute the full aggregation behind it."""
    return bounded_broadcast(cut_lineage(df), row_limit)


def two_phase_rank(df: DataFrame, order_col: str, partition_cols=(), rank_col: str = "rank",
                   tiebreak=(), digits: int = 3) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row within ``partition_cols``
    when sorted by the hex string ``order_col`` (then ``tiebreak``)."""
    parts = list(partition_cols)
    b = "__bucket"
    keyed = df.withColumn(b, _bucket(order_col, digits))
    counts = keyed.groupBy(*parts, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = (Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))).orderBy(b) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, b, F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    offsets = small_table(offsets)
    w = Window.partitionBy(*parts, b).orderBy(F.col(order_col), *[F.col(t) for t in tiebreak])
    ranked = keyed.join(offsets, on=[*parts, b], how="inner")
    return ranked.withColumn(rank_col, (F.col("__off") + F.row_number().over(w)).cast("long")) \
        .drop(b, "__off")


def dense_sequence(df: DataFrame, order_cols, id_col: str = "id") -> DataFrame:
    """Sequential id 1..n in ``order_cols`` order (WN-4), never one global task.

    Range-partition on the order columns (sampled bounds, balanced), sort inside
    each partition, number rows locally, then add the row count of all earlier
    partitions. The locally numbered table is checkpointed to the shared folder
    so that the count pass and the final pass see the same partition layout.
    """
    cols = [F.col(c) for c in order_cols]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(n_parts, *cols).sortWithinPartitions(*cols)
             .withColumn("__pid", F.spark_partition_id())
             .withColumn("__mid", F.monotonically_increasing_id()))
    local = local.withColumn("__ln", F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33) + 1)
    local = cut_lineage(local)
    sizes = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__pid", F.coalesce(F.sum("__cnt").over(w_off), F.lit(0)).alias("__off"))
    out = local.join(F.broadcast(offs), "__pid")  # one row per partition: bounded
    return out.withColumn(id_col, (F.col("__off") + F.col("__ln")).cast("long")) \
        .drop("__pid", "__mid", "__ln", "__off")
