"""Near-duplicate and containment joins against brute force."""

import random

from pyspark.sql import functions as F

from utterset.operators import generate
from utterset.operators.containment import contained_pairs
from utterset.operators.neardup import brute_force_pairs, near_duplicate_pairs


def _mutate(s, rng):
    i = rng.randrange(len(s))
    return s[:i] + rng.choice("的了是在") + s[i + 1:]


def test_near_dup_equals_brute_force_on_utterances(spark):
    g = generate.generate(spark, 40, seed=3).select("text").collect()
    rng = random.Random(5)
    texts = [r["text"] for r in g]
    left = [(i, t) for i, t in enumerate(texts[::2])]
    right = [(1000 + i, _mutate(t, rng) if i % 3 else t) for i, t in enumerate(texts[1::2])]
    right += [(5000 + i, t + "吗") for i, t in enumerate(texts[:40:2])]       # length + 1
    right += [(6000, ""), (6001, "x" * 70)]
    left += [(7000, ""), (7001, "x" * 69 + "y")]
    L = spark.createDataFrame(left, "id LONG, text STRING")
    Rt = spark.createDataFrame(right, "id LONG, text STRING")
    got = {(r["left_id"], r["right_id"]) for r in near_duplicate_pairs(L, Rt, threshold=0.9).collect()}
    want = brute_force_pairs(left, right, threshold=0.9)
    assert got == want
    assert len(want) > 20


def test_near_dup_equals_brute_force_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = d.collect()
    left = [tuple(r) for r in rows if r["id"] % 2 == 0]
    right = [tuple(r) for r in rows if r["id"] % 2 == 1]
    L = spark.createDataFrame(left, "id LONG, text STRING")
    Rt = spark.createDataFrame(right, "id LONG, text STRING")
    got = {(r["left_id"], r["right_id"]) for r in near_duplicate_pairs(L, Rt).collect()}
    assert got == brute_force_pairs(left, right)


def test_containment_equals_brute_force(spark):
    docs = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
            (2, "nothing to see here at all, really nothing whatsoever, not a thing"),
            (3, "prefix alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu suffix")]
    items = [(10, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),   # long path
             (11, "see here"),                                                    # short path
             (12, "absent passage that appears in no document of this small test")]
    D = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    I = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = {(r["item_id"], r["doc_id"]) for r in contained_pairs(D, I, k=8, w=8).collect()}
    want = {(i, d) for i, it in items for d, dt in docs if it in dt}
    assert got == want == {(10, 1), (10, 3), (11, 2)}
