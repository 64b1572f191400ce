"""Findings of the round's review on memory, disk and time: the same results from less."""

import random

from pyspark.sql import functions as F


def test_sparse_training_takes_the_steps_of_the_dense_one(spark):
    """Spark ML's trainer of networks, which copies rows into dense vectors, against sums
    over sparse rows: the same losses and weights, for dense vectors and rows of zeros too."""
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors

    from utterset.operators import softmax

    rng = random.Random(3)
    rows = [(float(rng.randrange(3)), Vectors.sparse(40, sorted((i, rng.random()) for i in rng.sample(range(40), 7)))) for _ in range(320)]
    rows += [(1.0, Vectors.sparse(40, {})), (2.0, Vectors.dense([0.5] * 40))]
    x = spark.createDataFrame(rows, ["label_idx", "features"]).repartition(2).localCheckpoint()
    net = MultilayerPerceptronClassifier(layers=[40, 3], seed=7, tol=1e-9, labelCol="label_idx", featuresCol="features")
    first = net.copy({net.maxIter: 0}).fit(x.limit(1)).weights.toArray()
    held = softmax.sparse_rows(x, 40)
    loss_at = softmax.objective(held, 3)
    for steps in (0, 3, 12):
        dense = net.copy({net.maxIter: steps}).fit(x)
        weights, loss = softmax.minimize(loss_at, first, steps, 1e-9)
        assert abs(loss - dense.summary().objectiveHistory[-1]) < 1e-9
        assert np.abs(weights - dense.weights.toArray()).max() < 1e-9
    # a row holds its own entries, not all features
    assert held.agg(F.max(F.length("value"))).first()[0] == 40 * 8 and held.filter("n = 7 AND length(value) = 56 AND length(at) = 28").count() == 320


def test_steps_are_bounded_and_stop_where_the_gradient_is_zero():
    import numpy as np

    from utterset.operators import softmax

    calls = []

    def bowl(x):
        calls.append(1)
        return float((x * x).sum()), 2 * x
    x, loss = softmax.minimize(bowl, np.array([3.0, -4.0]), 50, 1e-9)
    assert loss < 1e-12 and np.abs(x).max() < 1e-6 and len(calls) < 20
    assert softmax.minimize(bowl, np.zeros(2), 50, 1e-9)[1] == 0.0
