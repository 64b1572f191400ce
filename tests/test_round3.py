"""Dictionaries of any size, exact tokens, committed batches, keyed merges, draws from tables."""

import base64
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from utterset.functions import tokens as T
from utterset.operators import batch_annotate as B
from utterset.operators import dictionary, evaluate, neardup, prompt, rules, template_draws
from utterset.plans import synth
from utterset.session import path_exists, scratch_path
from utterset.sources import columns, io, versions
from utterset.streaming import feeds

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LABEL_JSON = '{"labels": [{"id": "A", "name": "a", "description": ""}]}'


# --- JN-8 --------------------------------------------------------------------------------

def test_dictionary_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    letters = "abAB é订议\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(120)] + ["", None, "𝄞 music 𝄞𝄞"]
    texts += texts[:20]
    words = [(rng.randrange(6), "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 9, 14)))), f"L{rng.randrange(40)}") for _ in range(400)]
    words += [(9, t[3:16], "PART") for t in texts if t and len(t) > 30][:20] + [(3, None, "NULL"), (3, "𝄞𝄞", "MUSIC"), (2, "absent from all", "NO")]
    for extra in ([], [(5, "", "EVERY")]):
        rows = words + extra
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("rule_label", F.lit("clash"))
        table = spark.createDataFrame(rows, "priority int, keyword string, label string")
        want = {}
        for i, t in enumerate(texts):
            found = [(p, lab) for p, k, lab in rows if t is not None and k is not None and k.lower() in t.lower()]
            want[i] = min(found)[1] if found else None
        for limit in (dictionary.SCAN_LIMIT, 0):
            monkeypatch.setattr(dictionary, "SCAN_LIMIT", limit)
            got = {r["id"]: r["rule_label"] for r in dictionary.match_dictionary(df, table).collect()}
            assert got == want
        assert {r["id"]: r["rule_label"] for r in rules.match_rules(df, table).collect()} == want
        assert {r["id"]: r["rule_label"] for r in rules.match_rules(df, table, broadcast_bytes=0).collect()} == want
    none = dictionary.match_dictionary(df, table.limit(0))
    assert none.filter("rule_label is not null").count() == 0 and none.count() == len(texts)
    assert dictionary.match_dictionary(df.limit(0), table).count() == 0


def test_dictionary_never_reaches_the_driver(spark, monkeypatch):
    """Only sizes of pieces and single rows are collected."""
    from pyspark.sql.classic.dataframe import DataFrame
    most, held = [], DataFrame.collect

    def counted(self):
        out = held(self)
        most.append(len(out))
        return out
    monkeypatch.setattr(DataFrame, "collect", counted)
    words = spark.range(5000).select((F.col("id") % 7).cast("int").alias("priority"), F.concat(F.lit("word"), F.col("id")).alias("keyword"), F.lit("L").alias("label"))
    df = spark.range(300).select(F.concat(F.lit("has word"), F.col("id") * 20, F.lit(" inside")).alias("text"))
    out = dictionary.match_dictionary(df, words)
    assert max(most) <= len(dictionary.PIECES)
    monkeypatch.undo()
    assert out.filter("rule_label = 'L'").count() == 300


# --- UD-3 --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    import tiktoken
    ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(rng, n=60):
    parts = ["hello", "Information", "don't", "  ", " \n\n", "12345", "é", "预订会议室", "!!!", " ", "\x1c", "\x85", "ſ", "<|endoftext|>", "a" * 30, "\t", "　", "'s", "'", "…"]
    return ["".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randrange(1, 40))) for _ in range(n)] + ["", " ", "x"]


def test_prefix_counts_equal_those_of_the_prefixes(plain):
    counter = T.Tokens(open(VOCABULARY, "rb").read(), T.PATTERN)
    for text in odd_texts(random.Random(2)):
        prefixes = T.Prefixes(counter, text)
        for end in range(len(text) + 1):
            assert prefixes.count(end) == len(plain.encode_ordinary(text[:end]))
            assert prefixes.count(end, " tail\n") == len(plain.encode_ordinary(text[:end] + " tail\n"))


def test_exact_trimming_and_counting(spark, plain):
    texts = [*odd_texts(random.Random(3)), None]
    counter = T.token_counter(spark, VOCABULARY)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = df.select("id", counter.count("text").alias("n"), *(counter.trim("text", k).alias(f"t{k}") for k in (0, 1, 7, 500))).collect()

    def count(t):
        return len(plain.encode_ordinary(t))
    for r in got:
        t = texts[r["id"]]
        if t is None:
            assert (r["n"], r["t0"], r["t7"]) == (None, None, None)
            continue
        assert r["n"] == count(t) and r["t0"] == ""
        for k in (1, 7, 500):
            cut = r[f"t{k}"]
            assert t.startswith(cut) and (count(cut) <= k) and (cut == t or count(t[:len(cut) + 1]) > k)


def test_exact_prompts(spark, plain):
    rng = random.Random(4)
    lines = [t.replace("\n", " ") for t in odd_texts(rng, 30)]
    user = "head " + prompt.SAMPLE_MARKER + "\n" + "\n".join(lines)
    counter = T.token_counter(spark, VOCABULARY)

    def count(t):
        return len(plain.encode_ordinary(t))
    long = "no marker " * 300
    df = spark.createDataFrame([(user,), (long,), ("short",), (None,)], "u string")
    for context in (150, 400, 3000):
        limit = context - 50 - 20 - count("system")
        got = [r[0] for r in df.select(counter.trim_prompt("u", "system", prompt.SAMPLE_MARKER, context, 50)).collect()]
        assert got[2:] == ["short", None] and count(got[1]) <= limit and long.startswith(got[1])
        if count(user) <= limit:
            assert got[0] == user
            continue
        before, kept = user[:user.index(prompt.SAMPLE_MARKER)] + prompt.SAMPLE_MARKER + "\n", []
        for line in user.partition(prompt.SAMPLE_MARKER)[2].splitlines():
            if count(before + "\n".join([*kept, line])) > limit:
                break
            kept.append(line)
        assert got[0] == before + "\n".join(kept)
    rows = [(g, i, t) for g in ("x", "y") for i, t in enumerate(odd_texts(rng, 80))] + [("x", 999, None)]
    packed = prompt.pack_samples_exact(spark.createDataFrame(rows, "g string, o int, text string"), counter, "o", group_cols=["g"],
                                       max_context_tokens=1500, output_reserve_tokens=100).collect()
    head, tail = prompt.SCHEMA_USER_TMPL.replace("{max_labels}", "25").split(prompt.SAMPLES_SLOT)
    for r in packed:
        own, kept = ["- " + t[:300] for g, _, t in sorted(rows, key=lambda x: x[:2]) if g == r["g"] and t is not None], []
        for line in own:
            if count(head + "\n".join([*kept, line]) + tail) + count(prompt.SCHEMA_SYS_PROMPT) + 20 > 1400:
                break
            kept.append(line)
        assert 0 < r["n_lines"] == len(kept) < len(own) and r["prompt"] == head + "\n".join(kept) + tail


# --- ML-2, UD-1 --------------------------------------------------------------------------

def _replier(log, fail_at=None, kind="raise"):
    """Replies to batches, noting each prompt it is paid for; breaks down at one of them."""
    def replies(prompts):
        with open(log, "a") as f:
            f.writelines("call\n" for _ in prompts)
        done = sum(1 for _ in open(log))
        if fail_at is not None and done >= fail_at and not os.path.exists(log + ".broken"):
            open(log + ".broken", "w").close()
            if kind == "exit":
                os._exit(1)
            raise SystemExit("the worker goes down")  # no Exception: not retried by the annotator
        return [json.dumps({"label_id": "a", "label_name": "n", "confidence": 0.5}) for _ in prompts]
    return replies


@pytest.mark.parametrize("kind", ["raise", "exit"])
def test_paid_replies_outlive_a_crash(spark, tmp_path, kind):
    log, store = str(tmp_path / "log"), scratch_path(spark, "replies")
    texts = spark.createDataFrame([(f"text {i}",) for i in range(200)], "text string")
    with pytest.raises(Exception):
        B.annotate_batches(texts, _replier(log, 120, kind), LABEL_JSON, store, batch_size=10, parallelism=2, attempts=1).count()
    paid = sum(1 for _ in open(log))
    out = B.annotate_batches(texts, _replier(log), LABEL_JSON, store, batch_size=10, parallelism=2, attempts=1)
    again = sum(1 for _ in open(log))
    assert out.count() == 200 and out.filter("label_id = 'A'").count() == 200
    committed = out.filter("from_cache").count()
    assert 90 <= committed < 200 and again - paid == 200 - committed
    assert again <= 200 + 2 * 10  # only batches in flight are paid twice
    third = B.annotate_batches(texts, _replier(log), LABEL_JSON, store, attempts=1)
    assert third.filter("from_cache").count() == 200 and sum(1 for _ in open(log)) == again


def test_a_retried_task_reads_its_committed_batches(tmp_path):
    commits, pace, calls = B.Commits(str(tmp_path / "s")), B.Pace(None, 0, 0), []

    def replies(prompts):
        calls.append(prompts)
        return [p.upper() for p in prompts]
    for _ in range(3):
        assert B.answer(replies, ["k1", "k2"], ["a", "b"], commits, pace, 2) == (["A", "B"], None)
    assert len(calls) == 1
    held = B.Commits("file:" + str(tmp_path / "s"))
    assert B.answer(replies, ["k1", "k2"], ["a", "b"], held, pace, 2) == (["A", "B"], None) and len(calls) == 1
    wrong = B.answer(lambda p: ["one"], ["x", "y"], ["a", "b"], commits, B.Pace(None, 0, 0), 2)
    assert wrong[0] == [None, None] and "1 replies to 2 prompts" in wrong[1]


def test_failed_batches_are_logged_and_paid_again(spark):
    store, errors, cache = (scratch_path(spark, n) for n in ("s", "e", "c"))
    texts = spark.createDataFrame([("good",), ("bad",), ("good",), (None,)], "text string")

    def replies(prompts):
        if any('"bad"' in p for p in prompts):
            raise RuntimeError("quota")
        return ['{"label_id": "a"}'] * len(prompts)
    run = [texts, replies, LABEL_JSON, store, cache, errors]
    got = {r["text"]: r for r in B.annotate_batches(*run, batch_size=1, attempts=2, wait_min=0.0).collect()}
    assert set(got) == {"good", "bad"} and got["bad"]["label_id"] == "OTHER" and got["good"]["label_id"] == "A"
    assert [r["text"] for r in spark.read.json(errors).collect()] == ["bad"] and path_exists(spark, cache)
    again = {r["text"]: r["from_cache"] for r in B.annotate_batches(*run, batch_size=1, attempts=1).collect()}
    assert again == {"good": True, "bad": False}


def test_calls_keep_the_pace():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s
    pace = B.Pace(2.0, 1.0, 8.0, sleep, lambda: now[0])
    for _ in range(4):
        pace.wait()
        pace.answered()
    assert waits == [0.5, 0.5, 0.5]
    waits.clear()
    for attempt in range(5):
        pace.failed(attempt)
    assert waits == [1, 2, 4, 8, 8] and pace.rate == 2.0 / 32
    for _ in range(20):
        pace.answered()
    assert pace.rate == 2.0


# --- ST-2 --------------------------------------------------------------------------------

def test_keyed_merge_over_restarts(spark, tmp_path):
    """Batches of one file, a stop in between, an existing table: the pairs that a batch
    merge gives, and the same work for each batch however large the table is."""
    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rng = random.Random(5)
    existing = spark.createDataFrame([(f"t{i}", "x") for i in range(20)], "text string, label string")
    seen, want, schema = {(f"t{i}", "x") for i in range(20)}, set(), "text string, label string, pos long"

    def add(k):
        rows = [(f"t{rng.randrange(60 + 40 * k)}", rng.choice(("x", "y", None)), 1000 * k + i) for i in range(150)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{k}")
        first = {}
        for t, lab, p in rows:
            first[t, lab] = min(first.get((t, lab), p), p)
        want.update((t, lab, p) for (t, lab), p in first.items() if (t, lab) not in seen)
        seen.update(first)

    def run():
        feed = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
        query = feeds.merge_keyed_feed(feed, out, ck, existing)
        query.awaitTermination()
        return [p for p in query.recentProgress if p["numInputRows"]]
    for k in range(2):
        add(k)
    first = run()
    for k in range(2, 4):
        add(k)
    second = run()
    got = {tuple(r) for r in spark.read.schema(schema).parquet(out).collect()}
    assert got == want and spark.read.parquet(out).count() == len(want)
    rows = [p["numInputRows"] for p in first + second]
    assert rows == [170, 150, 150, 150]  # the feed's rows, and once the existing table's
    assert all(p["stateOperators"][0]["numRowsUpdated"] <= 150 for p in second)


# --- GE-1, GE-2 --------------------------------------------------------------------------

def test_draws_are_distinct_and_shared(spark):
    templates = [("a", "Book {room} at {time}"), ("a", "Just {room}"), ("a", "plain"), ("a", "{time} or {time}, {room}"), ("a", None), ("a", "plain"),
                 ("b", "{none} here"), ("b", "say {word}"), ("c", "only")]
    values = [("room", f"R{i}") for i in range(30)] + [("time", f"{{room}} {i}h") for i in range(20)] + [("word", "w{word}"), ("word", None), ("room", "R1")]
    wanted = [("a", 400), ("b", 5), ("c", 0), ("d", 7)]
    args = [spark.createDataFrame(templates, "label string, template string"), spark.createDataFrame(values, "slot string, value string"),
            spark.createDataFrame(wanted, "label string, wanted long")]
    rows = template_draws.draw(*args, seed=3).collect()
    own = [r for r in rows if r["label"] == "a"]
    assert len(own) == 400 == len({r["text"] for r in own}) and sorted(r["sample_idx"] for r in own) == list(range(400))
    shapes = {"book": [r for r in own if r["text"].startswith("Book")], "just": [r for r in own if r["text"].startswith("Just")], "plain": [r for r in own if r["text"] == "plain"]}
    assert len(shapes["plain"]) == 1 and len(shapes["just"]) == 30  # all there are
    assert abs(len(shapes["book"]) - (400 - 31) / 2) <= 1
    assert all(r["text"][5:].split(" at ")[0] in {f"R{i}" for i in range(30)} and r["text"].endswith("h") for r in shapes["book"])
    assert [r["text"] for r in rows if r["label"] == "b"] == ["say w{word}"] and not any(r["label"] in "cd" for r in rows)
    again = template_draws.draw(*(a.repartition(3) for a in args), seed=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    other = {r["text"] for r in template_draws.draw(*args, seed=4).collect()}
    assert other != {r["text"] for r in rows}
    every = template_draws.draw(args[0], args[1], spark.createDataFrame([("a", 10**6)], "label string, wanted long"), seed=3).collect()
    assert len(every) == len({r["text"] for r in every}) == 600 + 30 + 1 + 600


# --- exact means -------------------------------------------------------------------------

def test_means_round_half_up_in_any_order(spark):
    values = [0.9034, 0.9035, 0.9034, 0.9034, 0.9035, 0.9034, 0.9035, 0.9036]
    df = spark.createDataFrame([("t", v) for v in values] + [("u", 0.1), ("u", None), ("v", None)], "k string, c double").repartition(5)
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(evaluate.exact_mean(F.col("c")).alias("m")).collect()}
    assert got == {"t": 0.903463, "u": 0.1, "v": None}  # 0.9034625


# --- GE-4, IO-6, SE-2: replacement --------------------------------------------------------

def test_a_crash_between_the_steps_leaves_the_old_set(spark, monkeypatch):
    out = scratch_path(spark, "set")
    synth.generate_and_save(spark, out, 20, ["CHECK_PAYSLIP", "COMPANY_LOOKUP"], seed=1)

    def rows():
        return sorted(map(str, versions.read_current(spark, out, "dataset").collect())), sorted(map(str, versions.read_current(spark, out, "label_mapping").collect()))
    before, seen = rows(), versions.current(spark, out)
    held = versions._write

    def crash(spark, path, manifest):
        raise SystemExit("down before the manifest")

    def cut_off(spark, path, manifest):
        where, files = versions._files(spark, path)
        stream = files.create(where, False)
        stream.write(bytearray(b'{"number": 2, "vers'))
        stream.close()
        raise SystemExit("down while writing the manifest")
    for broken in (crash, cut_off):
        monkeypatch.setattr(versions, "_write", broken)
        with pytest.raises(SystemExit):
            synth.generate_and_save(spark, out, 20, ["CHECK_PAYSLIP", "IT_TICKET"], seed=2)
        assert rows() == before and versions.current(spark, out) == seen
    monkeypatch.setattr(versions, "_write", held)
    second = synth.generate_and_save(spark, out, 20, ["CHECK_PAYSLIP", "IT_TICKET"], seed=2)
    assert second["report"] is not None and rows()[0] != before[0]
    index = {r["label"]: r["label_idx"] for r in versions.read_current(spark, out, "label_mapping").collect()}
    assert index == {"CHECK_PAYSLIP": 0, "COMPANY_LOOKUP": 1, "IT_TICKET": 2}
    assert versions.read_current(spark, out, "dataset_json").count() == second["merged"].count()
    assert len(versions.recover(spark, out, keep=1)) == 3  # two crashed ones and the first
    assert versions.read_current(spark, out, "dataset").count() == second["merged"].count()


def test_two_writers_cannot_both_win(spark):
    base = scratch_path(spark, "set")
    table = {"t": (spark.range(3), "parquet", [])}
    first = versions.replace(spark, base, table, None)
    versions.replace(spark, base, {"t": (spark.range(5), "parquet", [])}, first)
    with pytest.raises(versions.VersionConflict):
        versions.replace(spark, base, table, first)
    with pytest.raises(versions.VersionConflict):
        versions._write(spark, f"{base}/manifests/{2:012d}", first)
    assert versions.read_current(spark, base, "t").count() == 5 and versions.read_current(spark, base, "other") is None
    assert versions.current(spark, scratch_path(spark, "none")) is None


# --- IO-1, PX-1 ---------------------------------------------------------------------------

@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_rows_of_a_log_keep_their_order(spark, tmp_path, fmt):
    """The same numbers for one partition and for many splits of the files."""
    rows = spark.range(5000).select(F.concat(F.lit("question "), F.col("id")).alias("Question"), (F.col("id") % 3).alias("other"))
    path = str(tmp_path / "log")
    io.write_table(rows.coalesce(1).repartitionByRange(3, "Question").sortWithinPartitions("Question"), path, fmt)
    want = [r["Question"] for r in rows.orderBy("Question").collect()]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            log = spark.read.option("header", True).csv(path) if fmt == "csv" else io.read_table(spark, path, fmt)
            got = columns.resolve_question_log(log).collect()
            assert sorted((r["src_pos"], r["text"]) for r in got) == list(enumerate(want, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_question_column_by_length_and_ties(spark):
    def found(names, *rows):
        return columns.detect_question_column(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))
    assert found(["a", "b", "c"], ("xx", "yyy", "zzz"), ("xx", None, "zzz")) == ("b", "longest")
    assert found(["a", "b"], (None, None)) == ("a", "first")
    assert found(["my_text", "the content"], ("x", "yyyy")) == ("my_text", "fragment")
    assert found(["my_text", " Text ", "query"], ("x", "y", "z")) == ("query", "exact")


# --- JN-5 ---------------------------------------------------------------------------------

def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(40))) for _ in range(2))
        assert neardup.common_subsequence(a, b) == plain(a, b)


@pytest.mark.parametrize("limit", [neardup.BROADCAST_CHUNKS, 0])
def test_links_are_those_of_all_pairs_of_texts(spark, limit):
    """Edits up to the threshold and beyond in short and long texts (difflib treats those
    of 200 characters and more otherwise), copies, empty and null texts."""
    rng = random.Random(7)

    def text(n):
        return "".join(rng.choice("etaoin shrdlu.,XQ质") for _ in range(n))

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            i = rng.randrange(len(t) + 1)
            t[i:i + rng.randrange(2)] = rng.choice(("", "z", "e", "qq"))
        return "".join(t)
    base = [text(rng.choice((1, 5, 19, 20, 21, 40, 60, 190, 210, 400, 1200))) for _ in range(60)]
    left = [(i, t) for i, t in enumerate(base)] + [(100, ""), (101, None), (102, base[0]), (103, base[0])]
    right = [(1000 + i, edited(base[i % 60], rng.randrange(0, 1 + len(base[i % 60]) // 18))) for i in range(240)]
    right += [(2000 + i, base[0]) for i in range(3)] + [(3000, ""), (3001, None)]
    L, R = (spark.createDataFrame(x, "id long, text string").repartition(3) for x in (left, right))
    links, members = neardup.near_duplicate_links(L, R, threshold=0.9, broadcast_chunks=limit)
    rep = {(r["side"], r["id"]): r["rep"] for r in members.collect()}
    assert len(rep) == len(left) + len(right) - 2 and rep[0, 103] == 0 and rep[1, 2002] == min(i for i, t in right if t == base[0])
    want = neardup.brute_force_pairs(left, right, 0.9)
    got = [(r["left_rep"], r["right_rep"], r["left_copies"], r["right_copies"]) for r in links.collect()]
    assert {(rep[0, a], rep[1, b]) for a, b in want} == {g[:2] for g in got} and len(got) == len({g[:2] for g in got})
    assert all(n == sum(r == a for (s, _), r in rep.items() if s == 0) and m == sum(r == b for (s, _), r in rep.items() if s == 1) for a, b, n, m in got)
    assert neardup.near_dup_count(L, R, threshold=0.9).first()[0] == len({a for a, _ in want})
    assert neardup.near_duplicate_links(L.limit(0), R, threshold=0.9)[0].count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicate_links(L, R, threshold=0.5)


# --- ML-4 ---------------------------------------------------------------------------------

def test_the_best_round_is_not_the_last(spark):
    """Labels that are partly wrong in training: more rounds fit the errors, and the score
    on dev falls after its best."""
    from utterset.operators import evaluate
    from utterset.operators import model as ml
    rng = random.Random(8)

    def rows(n, noise):
        out = []
        for _ in range(n):
            y = rng.randrange(3)
            text = "".join(rng.choice("abcdefghij" + "xyz"[y] * 2) for _ in range(30))
            out.append((text, "ABC"[y if rng.random() > noise else rng.randrange(3)]))
        return spark.createDataFrame(out, "text string, label string")
    train, dev = rows(150, 0.5), rows(200, 0.0)
    model, curve = ml.fit_rounds(train, dev, rounds=12, iterations=3, patience=4, num_features=256)
    got = curve.orderBy("round").collect()
    best = next(r for r in got if r["best"])
    assert sum(r["best"] for r in got) == 1 and best["macro_f1"] == max(r["macro_f1"] for r in got)
    assert best["round"] < got[-1]["round"] and got[-1]["macro_f1"] < best["macro_f1"]
    assert got[-1]["round"] <= best["round"] + 4 and [r["iterations"] for r in got] == [3 * r["round"] for r in got]
    assert all(a["loss"] >= b["loss"] - 1e-9 for a, b in zip(got, got[1:]))  # each goes on where the last one stopped
    pred = ml.score(model, dev, keep=("label",)).select(F.col("label").alias("y"), F.col("intent").alias("pred"))
    assert abs(evaluate.macro_scores(pred).first()["f1"] - best["macro_f1"]) < 1e-9


def test_a_label_space_too_large_for_a_prompt_fails(spark, monkeypatch):
    monkeypatch.setattr(prompt, "LABEL_LIMIT", 3)
    space = spark.range(4).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("d").alias("description"))
    with pytest.raises(ValueError, match="3 labels"):
        prompt.compact_label_space(space, order_col="id")
    assert prompt.compact_label_space(space.limit(3), order_col="id").startswith('{"labels": [')


# --- ML-6 ---------------------------------------------------------------------------------

def test_topics_equal_a_plain_computation(spark):
    """Vectors, nearest centres and far texts of the result against plain Python; the same
    with other partitions; topics apart from each other come out as clusters."""
    import math
    from collections import Counter

    from utterset.operators import topics
    rng = random.Random(9)
    words = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    texts = [" ".join(rng.choice(words[i % 3]) for _ in range(rng.randrange(4, 9))) for i in range(90)] + ["", "!!", "zebra quagga okapi", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    args = (6, "text", r"(?U)\W+", 1000)
    found = topics.spherical_kmeans(df.repartition(3), *args)
    docs = {t: [w for w in t.lower().split() if w.isalnum()] for t in set(texts) - {None}}
    docs = {t: w + [f"{a} {b}" for a, b in zip(w, w[1:])] for t, w in docs.items() if w}
    df_of = Counter(x for w in docs.values() for x in set(w))
    want = {}
    for t, w in docs.items():
        v = {x: n * math.log((len(docs) + 1) / (df_of[x] + 1)) for x, n in Counter(w).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        want[t] = {x: y / size for x, y in v.items() if y > 0}
    import hashlib
    name = {hashlib.md5(t.encode()).digest(): t for t in docs}
    got = {}
    for r in found.vectors.collect():
        got.setdefault(name[bytes(r["key"])], {})[r["term"]] = r["weight"]
    assert set(got) == set(want)
    assert all(abs(got[t][x] - y) < 1e-8 for t in want for x, y in want[t].items())
    centres = {}
    for r in found.centres.collect():
        centres.setdefault(r["cluster"], {})[r["term"]] = r["weight"]
    assigned = {name[bytes(r["key"])]: r for r in found.assigned.collect()}
    assert set(assigned) == set(want)
    for t, v in want.items():
        cosines = {c: sum(y * centre.get(x, 0) for x, y in v.items()) for c, centre in centres.items()}
        assert abs(max(cosines.values()) - cosines[assigned[t]["cluster"]]) < 1e-6 and abs(assigned[t]["cosine"] - max(cosines.values())) < 1e-6
    again = {name[bytes(r["key"])]: r["cluster"] for r in topics.spherical_kmeans(df.repartition(7), *args).assigned.collect()}
    assert again == {t: r["cluster"] for t, r in assigned.items()}
    kinds = {}
    for i, t in enumerate(texts[:90]):
        kinds.setdefault(assigned[t]["cluster"], set()).add(i % 3)
    assert all(len(k) == 1 for k in kinds.values())


def test_a_text_far_from_its_cluster_gets_other(spark):
    from utterset.operators import model as ml
    rng = random.Random(10)
    base = ["reset my password please", "how do i book a meeting room"]
    texts = [b + rng.choice((" now", " today", " again", "")) + f" {i % 4}" for i in range(60) for b in base]
    texts.append("please " + " ".join(f"odd{i}" for i in range(25)))
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string")
    space, assign = ml.induce_label_space(df, max_labels=3)
    got = {r["text"]: r["label_id"] for r in assign.collect()}
    assert got[texts[-1]] == "OTHER" and sum(x == "OTHER" for x in got.values()) <= 3
    assert {r["id"] for r in space.collect()} == {"CLUSTER_0", "CLUSTER_1", "OTHER"}


# --- containment of short items -----------------------------------------------------------

def test_short_items_equal_brute_force(spark):
    from utterset.operators.containment import contained_pairs
    rng = random.Random(11)
    docs = [(i, "".join(rng.choice("abcé 预\n") for _ in range(rng.randrange(120)))) for i in range(80)] + [(100, None), (101, "")]
    items = [(i, "".join(rng.choice("abcé 预") for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 9))))) for i in range(150)]
    items += [(500 + i, t[5:45]) for i, t in docs[:30] if t and len(t) > 50] + [(900, None), (901, ""), (902, "not there at all"), (903, items[0][1])]
    items += [(1000 + i, t[:60]) for i, t in docs[30:50] if t and len(t) > 70]
    got = [(r["item_id"], r["doc_id"]) for r in contained_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                                                spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, d) for i, x in items if x for d, t in docs if t is not None and x in t}
