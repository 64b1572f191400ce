"""Generation, merge, label dictionaries, prompts, metrics, streaming, plans."""

import pytest
from pyspark.sql import functions as F

from utterset.operators import evaluate, generate, labels, merge, prompt
from utterset.plans import synth
from utterset.session import scratch_path


def test_generation_deterministic_and_grouped(spark):
    a = generate.generate(spark, 5, ["USER_LOOKUP", "CHECK_PAYSLIP"], seed=1).collect()
    b = generate.generate(spark, 5, ["USER_LOOKUP", "CHECK_PAYSLIP"], seed=1).collect()
    assert a == b
    groups = sorted(r["grp"] for r in a if r["label"] == "USER_LOOKUP")
    assert groups == [0, 1, 2, 3, 4]                       # n < 8: the first n groups
    g100 = generate.generate(spark, 100, ["USER_LOOKUP"]).groupBy("grp").count().collect()
    assert all(r["count"] >= 12 for r in g100)             # 12 per group + 4 drawn
    assert all("{" not in r["text"] for r in a)


def test_invalid_label_subset(spark):
    with pytest.raises(ValueError, match="NOPE"):
        generate.generate(spark, 3, ["NOPE"])


def test_merge_keeps_existing_first_and_is_idempotent(spark):
    old = spark.createDataFrame([("train", "t1", "A", 0), ("test", "t2", "A", 1)], "split STRING, text STRING, label STRING, pos LONG")
    new = spark.createDataFrame([("train", "t1", "A", 0), ("train", "t3", "B", 1), ("train", "t2", "A", 2)],
                                "split STRING, text STRING, label STRING, pos LONG")
    m = merge.merge_splits(old, new)
    rows = {(r["split"], r["text"]): r["origin"] for r in m.collect()}
    assert rows == {("train", "t1"): 0, ("test", "t2"): 1 - 1, ("train", "t3"): 1, ("train", "t2"): 1}
    again = merge.merge_splits(m.drop("origin"), new)
    assert again.count() == m.count()
    cross = merge.merge_splits(old, new, cross_split=True)
    assert ("train", "t2") not in {(r["split"], r["text"]) for r in cross.collect()}


def test_label_index_append(spark):
    existing = spark.createDataFrame([("B", 0), ("A", 1)], "label STRING, label_idx INT")
    seen = spark.createDataFrame([(x,) for x in ["A", "E", "B", "C", "D"]], "label STRING")
    got = {r["label"]: r["label_idx"] for r in labels.extend_label_index(existing, seen).collect()}
    assert got == {"B": 0, "A": 1, "C": 2, "D": 3, "E": 4}


def test_label_map_last_wins(spark):
    df = spark.createDataFrame([(1, "x", "n1"), (2, "x", "n2"), (3, "y", "n2"), (4, "x", "n1")],
                               "pos INT, id STRING, name STRING")
    fwd = {r["id"]: r["name"] for r in labels.label_map_last_wins(df, "id", "name", "pos").collect()}
    inv = {r["name"]: r["id"] for r in labels.inverse_map_last_wins(df, "id", "name", "pos").collect()}
    assert fwd == {"x": "n2", "y": "n2"} and inv == {"n2": "y"}


def test_unknown_labels_fail(spark):
    df = spark.createDataFrame([("A",), ("Z",), ("Z",)], "label STRING")
    known = spark.createDataFrame([("A",)], "label STRING")
    with pytest.raises(ValueError, match="Z"):
        labels.require_known_labels(df, known)


def test_packing_fits_and_is_maximal(spark):
    rows = [(i, "问题" * (i % 50 + 1)) for i in range(3000)]
    q = spark.createDataFrame(rows, "src_pos LONG, text STRING")
    out = prompt.pack_samples(q, max_samples=0, max_context_tokens=2048, output_reserve_tokens=256).first()
    budget = 2048 - 256
    need = prompt.py_token_estimate(prompt.SCHEMA_SYS_PROMPT) + prompt.py_token_estimate(out["prompt"]) + 20
    assert need <= budget
    nxt = "- " + rows[out["n_lines"]][1][:300]
    bigger = out["prompt"].replace("\n\n", "\n\n", 1)
    longer = prompt.py_token_estimate(bigger) + -(-(len(nxt) + 1) // 4)
    assert prompt.py_token_estimate(prompt.SCHEMA_SYS_PROMPT) + prompt.py_token_estimate(
        out["prompt"] + "\n" + nxt) + 20 > budget or longer > budget


def test_metrics_match_hand_computation(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("c", "c")]
    df = spark.createDataFrame(pairs, "y STRING, pred STRING")
    m = evaluate.macro_scores(df).first()
    cls = ["a", "b", "c"]
    p = [sum(1 for y, q in pairs if y == q == c) / max(1, sum(1 for _, q in pairs if q == c)) for c in cls]
    r = [sum(1 for y, q in pairs if y == q == c) / max(1, sum(1 for y, _ in pairs if y == c)) for c in cls]
    f = [2 * a * b / (a + b) if a + b else 0.0 for a, b in zip(p, r)]
    assert m["precision"] == round(sum(p) / 3, 6) and m["recall"] == round(sum(r) / 3, 6)
    assert abs(m["f1"] - sum(f) / 3) < 1e-6 and m["accuracy"] == round(4 / 6, 6)
    cm = {(x["y"], x["pred"]): x["n"] for x in evaluate.confusion_long(df).collect()}
    assert len(cm) == 9 and cm[("c", "a")] == 1 and cm[("b", "a")] == 0


def test_synth_route_merges_and_keeps_ids(spark):
    out = scratch_path(spark, "synth")
    first = synth.generate_and_save(spark, out, 20, ["CHECK_PAYSLIP", "COMPANY_LOOKUP"], seed=1)
    n1 = first["merged"].count()
    idx1 = {r["label"]: r["label_idx"] for r in first["label_index"].collect()}
    second = synth.generate_and_save(spark, out, 20, ["CHECK_PAYSLIP", "IT_TICKET"], seed=2)
    idx2 = {r["label"]: r["label_idx"] for r in second["label_index"].collect()}
    assert all(idx2[k] == v for k, v in idx1.items()) and idx2["IT_TICKET"] == 2
    assert second["report"] is not None and second["merged"].count() > n1
    dup = second["merged"].groupBy("split", "text", "label").count().filter("count > 1").count()
    assert dup == 0


def test_existing_dataset_is_found_by_uri_and_a_bad_one_fails(spark, tmp_path):
    import pytest

    from utterset.sources import io
    uri = f"file://{tmp_path}/set"
    assert io.read_existing(spark, uri) is None
    spark.range(3).write.parquet(uri)
    assert io.read_existing(spark, uri).count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        io.read_existing(spark, f"file://{tmp_path}/bad").count()


def test_metrics_read_their_rows_once_and_take_nulls(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), (None, "a"), ("c", None)]
    df = spark.createDataFrame(rows, "y STRING, pred STRING")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["support"]) for r in evaluate.per_class(df).collect()}
    assert got == {"a": (1, 1, 1, 2), "b": (1, 1, 0, 1), "c": (0, 0, 1, 1), None: (0, 1, 1, 1)}
    acc = evaluate.accuracy(df).first()
    assert (acc["n"], acc["accuracy"]) == (5, 2 / 3)
    empty = evaluate.accuracy(df.limit(0)).first()
    assert (empty["n"], empty["accuracy"]) == (0, None)
    plan = evaluate.per_class(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
