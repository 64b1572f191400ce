"""Split properties: sizes, quotas, disjointness, no group leak, partition invariance."""

import math

import pytest
from pyspark.sql import functions as F

from utterset.operators import split as S
from utterset.operators.rank import dense_sequence, two_phase_rank
from utterset.functions.hashing import order_key


def frame(spark, n, labels=("a", "b", "c")):
    rows = [(i, f"text {i}", labels[i % len(labels)]) for i in range(n)]
    return spark.createDataFrame(rows, "id LONG, text STRING, label STRING")


@pytest.mark.parametrize("n", [9, 10, 29, 30, 1000])
def test_sizes_follow_library_arithmetic(spark, n):
    s = S.stratified_split(frame(spark, n), "label", "id")
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    if n < 10:
        assert got == {"train": n}
        return
    hold = math.ceil(0.2 * n)
    test = math.ceil(0.5 * hold)
    assert got.get("train", 0) == n - hold
    assert got.get("dev", 0) == hold - test
    assert got.get("test", 0) == test
    assert s.select("id").distinct().count() == n


def test_per_label_quota_within_one(spark):
    df = frame(spark, 1000, labels=("a",) * 7 + ("b",) * 2 + ("c",))
    s = S.stratified_split(df, "label", "id")
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab, n_c in (("a", 700), ("b", 200), ("c", 100)):
        assert abs(per[(lab, "train")] - 0.8 * n_c) <= 1


def test_single_member_class_stays_in_train(spark):
    rows = [(i, f"t{i}", "big") for i in range(40)] + [(99, "lonely", "tiny")]
    df = spark.createDataFrame(rows, "id LONG, text STRING, label STRING")
    s = S.stratified_split(df, "label", "id")
    assert s.filter("label = 'tiny'").first()["split"] == "train"
    assert S.too_small_classes(df, "label").count() == 1


def test_partition_invariance(spark):
    base = frame(spark, 500)
    outs = []
    for parts in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        shuffled = base.repartition(parts).orderBy(F.rand(parts))
        outs.append(sorted(tuple(r) for r in S.stratified_split(shuffled, "label", "id").select("id", "split").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0] == outs[1] == outs[2]


def test_two_phase_rank_equals_window(spark):
    df = frame(spark, 3000).withColumn("ok", order_key(7, "id"))
    got = two_phase_rank(df, "ok", ("label",), "r", tiebreak=("id",)).select("id", "r").collect()
    from pyspark.sql import Window
    w = Window.partitionBy("label").orderBy("ok", "id")
    want = df.withColumn("r", F.row_number().over(w)).select("id", "r").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_dense_sequence(spark):
    df = spark.createDataFrame([(i * 3 + 1,) for i in range(2000)], "pos LONG").repartition(5)
    got = sorted(tuple(r) for r in dense_sequence(df, ["pos"], "id").collect())
    assert got == [(i * 3 + 1, i + 1) for i in range(2000)]


def test_group_split_no_leak_and_dev_share(spark):
    rows = []
    for i in range(400):
        lab = "x" if i % 3 else "y"
        rows.append((i, f"text  {i % 150}", lab))     # repeated texts -> groups
    df = spark.createDataFrame(rows, "pos LONG, text STRING, label STRING")
    s = S.group_split(df, "text", "label", "pos")
    assert S.leaked_groups(s).count() == 0
    g = s.select("norm_text", "group_label", "split").distinct()
    per = {(r["group_label"], r["split"]): r["count"] for r in g.groupBy("group_label", "split").count().collect()}
    for lab in ("x", "y"):
        total = per.get((lab, "dev"), 0) + per.get((lab, "train"), 0)
        assert abs(per.get((lab, "dev"), 0) - total / 5) <= 1


def test_prefix_split(spark):
    s = S.per_label_prefix_split(frame(spark, 103), "label", "id")
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab, n_c in (("a", 35), ("b", 34), ("c", 34)):
        assert per[(lab, "train")] == int(n_c * 0.8)
