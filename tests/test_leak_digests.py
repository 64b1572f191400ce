"""F10 of the round's review: the leak audit compares digests."""

import random

from pyspark.sql import functions as F


def test_a_leak_report_shuffles_digests_and_not_texts(spark):
    """the report of texts and of their digests, with null, empty and repeated texts; a
    digest's order key is that of the text, so the groups are ranked as before."""
    from utterset.operators import audit, split
    from utterset.plans import audit as route

    rng = random.Random(5)
    texts = [f"{'x' * 400} {rng.randrange(12)}{rng.choice(('', ' ', chr(0x3000)))}" for _ in range(60)] + ["", " ", None, None]
    rows = [(i, t, rng.choice("ab")) for i, t in enumerate(texts)]
    train, dev = (spark.createDataFrame(rows[i::2], "pos long, text string, label string") for i in (0, 1))
    both = train.withColumn("__side", F.lit(0)).unionByName(dev.withColumn("__side", F.lit(1)))
    parts = split.group_split(both.withColumn("__ord", F.struct("__side", "pos")), "text", "label", "__ord")
    after = [parts.filter(F.col("split") == s) for s in ("train", "dev")]
    want = {("before", "conflicting_groups"): audit.conflicts(both).count(), ("before", "train_rows"): 32, ("before", "dev_rows"): 32,
            ("before", "texts_on_both_sides"): audit.exact_overlap(train, dev).count(), ("after", "leaked_groups"): 0,
            ("after", "train_rows"): after[0].count(), ("after", "dev_rows"): after[1].count(), ("after", "texts_on_both_sides"): audit.exact_overlap(*after).count()}
    assert want["before", "conflicting_groups"] > 5 and want["after", "dev_rows"] > 0
    for sides in ((train, dev), [route.text_keys(df) for df in (train, dev)]):
        report = route.leak_report(*sides)
        assert {(r["stage"], r["measure"]): r["n"] for r in report.collect()} == want
    keyed = route.text_keys(both).join(both.select("pos", "text"), "pos")
    assert keyed.filter(~route.key_order().eqNullSafe(split.order_key(42, split.group_key("text")))).isEmpty()
    assert keyed.agg(F.max(F.length("norm_text"))).first()[0] == 52 and "text" not in route.text_keys(both).columns
