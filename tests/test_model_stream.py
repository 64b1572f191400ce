"""Classifier round trip (ML-4/5/7, IO-9), wide confusion matrix, stream merge re-run."""

from pyspark.sql import functions as F

from utterset.operators import evaluate
from utterset.operators import model as M
from utterset.session import scratch_path
from utterset.streaming import feeds

from .conftest import SF_SMALL

def test_model_fit_score_save_load(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))
    train = d.filter(F.col("doc_id") % 5 != 0)
    dev = d.filter(F.col("doc_id") % 5 == 0)
    m, grid = M.fit_best(train, dev, reg_params=(0.0, 0.1), num_features=1 << 12, max_iter=20)
    assert grid.count() == 2
    scored = M.score(m, dev, keep=("label",)).collect()
    for r in scored:
        assert abs(sum(r["probs"].values()) - 1.0) <= 0.0005 * len(r["probs"])
        assert r["confidence"] == max(r["probs"].values())
    acc = sum(r["intent"] == r["label"] for r in scored) / len(scored)
    assert acc > 0.8
    path = scratch_path(spark, "model")
    M.save(m, path)
    m2 = M.load(path)
    again = M.score(m2, dev, keep=("label",)).collect()
    assert [r["intent"] for r in again] == [r["intent"] for r in scored]
    info = M.model_info(m2, path, 64).first()
    assert info["num_labels"] == len(M.labels_of(m2)) and info["intent_labels"] == sorted(info["intent_labels"])

def test_confusion_wide(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y STRING, pred STRING")
    rows = {r["y"]: r.asDict() for r in evaluate.confusion_wide(df, labels=["a", "b", "c"]).collect()}
    assert rows["a"]["a"] == 1 and rows["a"]["b"] == 1 and rows["a"]["c"] == 0 and rows["b"]["b"] == 1

def test_stream_merge_rerun_is_idempotent(spark):
    src = scratch_path(spark, "src")
    rows = [("t1", "A", 1), ("t1", "A", 2), ("t2", "B", 3)]
    spark.createDataFrame(rows, "text STRING, label STRING, pos LONG").write.parquet(src)
    schema = spark.read.parquet(src).schema
    table, ck = scratch_path(spark, "tbl"), scratch_path(spark, "ck")
    feeds.merge_feed(feeds.file_feed(spark, src, schema), table, ck).awaitTermination()
    first = sorted(tuple(r) for r in spark.read.parquet(table).select("text", "label", "pos").collect())
    assert first == [("t1", "A", 1), ("t2", "B", 3)]
    # new file with one old and one new pair; the old pair must not be appended again
    spark.createDataFrame([("t2", "B", 9), ("t3", "C", 10)], "text STRING, label STRING, pos LONG") \
        .write.mode("append").parquet(src)
    feeds.merge_feed(feeds.file_feed(spark, src, schema), table, ck).awaitTermination()
    second = sorted(tuple(r) for r in spark.read.parquet(table).select("text", "label", "pos").collect())
    assert second == [("t1", "A", 1), ("t2", "B", 3), ("t3", "C", 10)]


def test_external_scorer_rejects_another_shape(spark):
    import numpy as np
    import pytest

    from utterset.operators.external import score_external
    df = spark.createDataFrame([("a",), (None,), ("b b",)], "text STRING")
    got = score_external(df, lambda: lambda texts: np.array([[len(t), 4 - len(t)] for t in texts]) / 4, ["x", "y"], batch=2).collect()
    assert sorted((r["text"] or "", r["intent"], r["confidence"]) for r in got) == [("", "y", 1.0), ("a", "y", 0.75), ("b b", "x", 0.75)]
    with pytest.raises(Exception, match="for 3 texts|for 2 texts|for 1 texts"):
        score_external(df, lambda: lambda texts: np.zeros((1, 3)), ["x", "y"]).collect()


def test_training_loader_names_unknown_labels(spark, tmp_path):
    import pytest

    from utterset.sources import io
    rows = [(" hi ", " a "), ("yo", "B"), (None, "a"), ("no", None)]
    io.write_table(spark.createDataFrame(rows, "question STRING, label STRING"), str(tmp_path / "t"), "csv")
    known = spark.createDataFrame([("A",), ("B",)], "label STRING")
    got = io.read_labelled_csv(spark, str(tmp_path / "t"), known)
    assert sorted(map(tuple, got.collect())) == [("hi", "A"), ("yo", "B")]
    with pytest.raises(ValueError, match="B"):
        io.read_labelled_csv(spark, str(tmp_path / "t"), known.filter("label = 'A'"))


def test_label_space_of_chinese_texts_and_other(spark):
    from utterset.operators import model as ml

    topics = ["请帮我预订会议室", "查询我的工资单", "我想申请休假"]
    texts = [t + x for t in topics for x in ("谢谢", "吧", "一下", "可以吗", "明天")] + ["...", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    space, assign = ml.induce_label_space(df, max_labels=5)
    got = {r["text"]: r["label_id"] for r in assign.collect()}
    assert got["..."] == "OTHER" and all(got[t] != "OTHER" for t in texts if t != "...")
    assert len({got[t] for t in texts[:15]}) > 1
    named = {r["id"]: r["keywords"] for r in space.collect()}
    assert all(named[got[t]] for t in texts if t != "...")
    _, strict = ml.induce_label_space(df, max_labels=5, other_cosine=1.01)
    assert {r["label_id"] for r in strict.collect()} == {"OTHER"}
