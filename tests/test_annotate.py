"""Annotator with cache: hits skip the call, failures are not cached, replies parse."""

import json

from pyspark.sql import functions as F

from utterset.functions.replies import parse_reply, reply_error, reply_fields
from utterset.operators import annotate as A
from utterset.session import scratch_path

LABEL_JSON = '{"labels": [{"id": "A", "name": "a", "description": ""}]}'


def test_second_run_makes_no_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def annotator(prompt):
        calls.add(1)
        if "boom" in prompt:
            raise RuntimeError("remote error")
        return json.dumps({"label_id": "a", "label_name": "甲", "confidence": "0.8"})

    texts = spark.createDataFrame([("one",), ("two",), ("boom",)], "text STRING")
    cache, errors = scratch_path(spark, "c"), scratch_path(spark, "e")
    first = {r["text"]: r for r in A.annotate(texts, annotator, LABEL_JSON, cache, errors, attempts=2,
                                              wait_min=0.0, wait_max=0.0).collect()}
    assert calls.value == 2 + 2          # two texts once, the failing one twice (retries)
    assert first["one"]["label_id"] == "A" and first["one"]["confidence"] == 0.8
    assert first["boom"]["label_id"] == A.FALLBACK_ID and first["boom"]["confidence"] == 0.0
    assert spark.read.json(errors).count() == 1
    calls2 = calls.value
    second = {r["text"]: r for r in A.annotate(texts, annotator, LABEL_JSON, cache, errors, attempts=1,
                                               wait_min=0.0).collect()}
    assert calls.value - calls2 == 1     # only the uncached failure is retried
    assert second["one"]["from_cache"] and not second["boom"]["from_cache"]
    # a changed label space changes every key: all miss
    third = A.annotate(texts, annotator, LABEL_JSON + " ", cache, errors, attempts=1, wait_min=0.0).collect()
    assert not any(r["from_cache"] for r in third)


REPLIES = [
    ('```json\n{"label_id": "x", "confidence": 0.9}\n```', None, "X", 0.9),
    ('Here: {"label_id": "y", "label_name": "n"} ok', None, "Y", 0.5),
    ('{"label_id": "z", "confidence": "0.25",}', None, "Z", 0.25),
    ('{"label_id": "w", "confidence": "high"}', None, "W", 0.5),
    ('{"label_id": 5, "confidence": 1}', None, "5", 1.0),
    ("no json here", "invalid json", None, None),
    ("", "empty response", None, None),
    ('[1, 2]', "not a json object", None, None),
]


def test_reply_parsing(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i INT, reply STRING")
    df = df.withColumn("v", parse_reply("reply"))
    f = reply_fields(F.col("v"))
    out = df.select("i", reply_error("reply", F.col("v")).alias("err"), f["label_id"].alias("lid"),
                    f["confidence"].alias("c")).orderBy("i").collect()
    for r, (_, err, lid, conf) in zip(out, REPLIES):
        assert r["err"] == err
        if err is None:
            assert r["lid"] == lid and r["c"] == conf
