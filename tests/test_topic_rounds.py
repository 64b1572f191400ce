"""F12 of the round's review: a round of the topics is one pass, without a join of all terms."""

import random

import numpy as np


def test_rounds_equal_plain_sums(spark, monkeypatch):
    from utterset.operators import topics

    rng = random.Random(4)
    n, size, k = 300, 50, 4
    rows = [sorted((at, round(rng.random(), 9)) for at in rng.sample(range(size), rng.randrange(1, 12))) for _ in range(n)]
    packed = spark.createDataFrame([(bytes([i // 256, i % 256]), [a for a, _ in v], [w for _, w in v]) for i, v in enumerate(rows)],
                                   "key binary, at array<long>, weight array<double>").repartition(5)
    dense = np.zeros((n, size))
    for i, v in enumerate(rows):
        for at, w in v:
            dense[i, at] = w
    gen = np.random.default_rng(1)
    one, two = gen.random((size, k)).round(9), gen.random((size, k)).round(9)
    one[:, 3] = one[:, 1]  # equally near: the first
    monkeypatch.setattr(topics, "ENTRIES", 64)
    near = [(dense @ c).round(9).argmax(axis=1) for c in (one, two)]
    sums, moved = topics._round(packed, one, two)
    want = np.stack([dense[near[0] == i].sum(axis=0) for i in range(k)], axis=1)
    assert np.abs(sums - want).max() < 1e-9 and moved == (near[0] != near[1]).sum() > 0 and not sums[:, 3].any()
    got = {int.from_bytes(r["key"], "big"): (r["cluster"], r["cosine"]) for r in topics._assigned(packed, one).collect()}
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(near[0].tolist())) and len(got) == n
    assert all(abs(cosine - (dense[i] @ one)[c]) < 1e-8 for i, (c, cosine) in got.items())


def test_no_texts_have_no_topics(spark):
    from utterset.operators import topics

    found = topics.spherical_kmeans(spark.createDataFrame([("",), (None,)], "text string"), 3, "text", r"(?U)\W+", 100)
    assert found.centres.count() == found.assigned.count() == found.vectors.count() == 0
