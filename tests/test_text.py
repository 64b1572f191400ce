"""Whitespace and Unicode table (note W): Spark functions vs Python's str."""

import re

from pyspark.sql import functions as F

from utterset.functions import text as T

CASES = ["  a  b  ", "　查询　工资　", "a\tb\nc\r\nd", "\x1c x \x1f", "", "   ", " x y ",
         "emoji 😀  here", "nan", "no-space"]


def _collect(spark, col):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "i INT, s STRING")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_collapse_matches_python(spark):
    got = _collect(spark, T.collapse_space("s"))
    assert got == [re.sub(r"\s+", " ", s.strip()) for s in CASES]


def test_remove_space_matches_python(spark):
    got = _collect(spark, T.remove_space("s"))
    assert got == [re.sub(r"\s+", "", s.strip()) for s in CASES]


def test_strip_matches_python(spark):
    got = _collect(spark, T.py_strip("s"))
    assert got == [s.strip() for s in CASES]


def test_length_counts_code_points(spark):
    got = _collect(spark, F.length("s"))
    assert got == [len(s) for s in CASES]


def test_token_estimate_and_trim(spark):
    got = _collect(spark, T.token_estimate("s"))
    assert got == [max(1, -(-len(s) // 4)) for s in CASES]
    got = _collect(spark, T.trim_to_tokens("s", 1))
    assert got == [s[:4] for s in CASES]
    assert _collect(spark, T.trim_to_tokens("s", 0)) == [""] * len(CASES)


def test_sanitize_label_id(spark):
    df = spark.createDataFrame([("check-payslip 1", "x"), ("请假", "请假"), (None, "n")], "i STRING, n STRING")
    got = [r[0] for r in df.select(T.sanitize_label_id("i", "n")).collect()]
    import hashlib
    assert got[0] == "CHECKPAYSLIP1"
    assert got[1] == hashlib.md5("请假".encode()).hexdigest()[:8].upper()
    assert got[2] == hashlib.md5(b"n").hexdigest()[:8].upper()


def test_json_quote_matches_json_dumps(spark):
    import json
    vals = ['a"b', "c\\d", "e\nf\tg", "中文", *(f"a{chr(i)}b" for i in range(0x20)), "\x7f\u2028"]
    df = spark.createDataFrame([(v,) for v in vals], "v STRING")
    got = [r[0] for r in df.select(T.json_quote("v")).collect()]
    assert got == [json.dumps(v, ensure_ascii=False) for v in vals]


def test_split_lines_matches_splitlines(spark):
    vals = ["", "a", "a\n", "\n", "a\r\nb\r", "a\x0bb\x0cc\n\n", "\x1ca\x1eb\x85", "a\u2028b\u2029", "a\n\rb", "a\x1fb "]
    df = spark.createDataFrame([(v,) for v in vals], "v STRING")
    assert [r[0] for r in df.select(T.split_lines("v")).collect()] == [v.splitlines() for v in vals]


def test_question_column_by_name_and_fragment(spark):
    from utterset.sources.columns import detect_question_column

    def found(names):
        return detect_question_column(spark.createDataFrame([("x",) * len(names)], names))
    assert found(["id", "Text", " QUERY "]) == (" QUERY ", "exact")
    assert found(["id", "text", "Text "]) == ("text", "exact")
    assert found(["id", "user_text", "my_question"]) == ("user_text", "fragment")
