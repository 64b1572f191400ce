"""Findings of the round's review: tables that are folders, texts that share a line, rows of equal vectors."""

from pyspark.sql import functions as F


def _table(spark, folder, name, rows, schema, files):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/{name}.parquet")


def test_streams_over_tables_of_several_files(spark, tmp_path):
    from utterset.plans import catalog

    turns = [(c, t, "user" if t % 2 else "system", f"how do I pay {c}" if c % 3 else "") for c in range(12) for t in range(1, 4)]
    _table(spark, tmp_path, "conversations", turns, "conv_id long, turn long, role string, text string", 3)
    docs = [(i, f"text {i % 7}", "en", f"s{i % 2}", 6) for i in range(40)]
    _table(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long", 3)
    _table(spark, tmp_path, "labels", [(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int", 2)
    scored = {(r["conv_id"], r["turn"]) for r in catalog.stream_score_questions(spark, str(tmp_path)).collect()}
    assert scored == {(c, t) for c, t, role, text in turns if role == "user" and text}
    first = {}
    for i, text, _, source, _ in docs:
        first.setdefault((text, source), i)
    assert {r["pos"] for r in catalog.stream_merge_documents(spark, str(tmp_path)).collect()} == set(first.values())
    known = {(text, source) for i, text, _, source, _ in docs if i < 4}
    assert {r["pos"] for r in catalog.stream_merge_keyed(spark, str(tmp_path)).collect()} == {i for k, i in first.items() if k not in known}


def test_words_of_a_dictionary_by_their_hash(spark, monkeypatch):
    import random

    from utterset.operators import dictionary

    rng = random.Random(3)
    texts = ["".join(rng.choice("abÄ 订") for _ in range(rng.randrange(90))) for _ in range(60)] + ["", None]
    words = [(rng.randrange(4), "".join(rng.choice("abÄ订") for _ in range(rng.choice((1, 3, 5, 9, 17)))), f"L{i}") for i in range(150)]
    words += [(2, t[:70], "LONG") for t in texts if t and len(t) > 70] + [(0, t[2:40], "PART") for t in texts if t and len(t) > 40][:9]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame(words, "priority int, keyword string, label string")
    want = {i: min(((p, lab) for p, k, lab in words if t is not None and k.lower() in t.lower()), default=(0, None))[1] for i, t in enumerate(texts)}

    def got():
        return {r["id"]: r["rule_label"] for r in dictionary.match_dictionary(df, table).collect()}

    anchored, calls = dictionary.anchors, []
    monkeypatch.setattr(dictionary, "anchors", lambda t, w: calls.append(w.count()) or anchored(t, w))
    assert got() == want
    assert calls == [len({k.lower() for _, k, _ in words if len(k) > dictionary.LONGEST})]  # no pieces of the others
    by_hash = dictionary._first_by_hash  # as if hashes had fallen together
    monkeypatch.setattr(dictionary, "_first_by_hash", lambda *a: by_hash(*a).withColumn("__word", F.lit("zzz")))
    assert got() == want


def test_a_caller_holds_a_slice_of_prompts_at_a_time():
    import pyarrow as pa

    from utterset.operators import annotate

    rows = [(str(i), "x" * 100_000, f"{i} " + "x" * 100_000 if i % 7 else "") for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["cache_key", "text", "prompt"])
    out = list(annotate._caller(lambda p: p[:2] or 1 / 0, 1, 0, 0)([batch]))
    assert len(out) > 3 and max(b.num_rows for b in out) <= 15
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert [g[:2] for g in got] == [r[:2] for r in rows]
    assert [g[2] for g in got] == [p[:2] or None for _, _, p in rows] and all((g[3] is None) == bool(g[2]) for g in got)


def test_fingerprints_take_little_memory():
    import tracemalloc

    import numpy as np

    from utterset.operators import containment as C

    text = "".join(chr(97 + i * i % 23 + i % 3) for i in range(200_000)) + "订Ä"
    tracemalloc.start()
    got = C._fingerprints(text, C.K_GRAM, C.WINDOW)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(text)
    codes = [ord(c) for c in text[:300]]
    mask, hashes = (1 << 64) - 1, []
    for i in range(300 - C.K_GRAM + 1):
        h = sum(c * pow(int(C._BASE), C.K_GRAM - 1 - j, 1 << 64) for j, c in enumerate(codes[i : i + C.K_GRAM])) & mask
        h = (h ^ (h >> 29)) * int(C._MIX) & mask
        hashes.append(h ^ (h >> 32))
    want = {min(hashes[i : i + C.WINDOW]) for i in range(len(hashes) - C.WINDOW + 1)}
    assert want <= set(np.asarray(got).view(np.uint64).tolist())


def test_a_counter_holds_a_slice_of_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    from utterset.functions import batches, tokens

    taken, held = [], tokens.by_slices
    monkeypatch.setattr(tokens, "by_slices", lambda run, texts, kind: held(lambda part: taken.append(len(part)) or run(part), texts, kind))
    monkeypatch.setattr(tokens, "_column", lambda c: c)
    made = []
    monkeypatch.setattr(tokens.F, "arrow_udf", lambda run, kind: made.append(run) or (lambda c: c))

    class Words:
        split = __import__("regex").compile(r"\S+\s*")
        count = staticmethod(lambda t: len(t.split()))
        piece = staticmethod(lambda t: len(t.split()))

    monkeypatch.setattr(tokens.TokenCounter, "tokens", lambda self: Words)
    counter = tokens.TokenCounter(None, "", "")
    texts = [None, "", "a b c", *["word " * 60_000] * 12, "z"]
    counter.count("t")
    counter.trim("t", 2)
    counts, prefixes = (next(run(iter([pa.array(texts)]))).to_pylist() for run in made)
    assert counts == [None if t is None else len(t.split()) for t in texts]
    assert [p if p is None else p.split() for p in prefixes] == [t if t is None else t.split()[:2] for t in texts]
    assert sum(taken) == 2 * len(texts) and max(taken) < len(texts) / 2
    assert batches.by_slices(lambda part: pa.array(part, pa.string()), pa.array([], pa.string()), pa.string()).to_pylist() == []


def test_texts_are_taken_apart_once_for_training(spark):
    from utterset.operators import model as M

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(f"{'abc'[i % 3] * 4} {i}", "ABC"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, label string")
    model, grid = M.fit_best(df.mapInArrow(counted, df.schema), df, reg_params=(0.0, 0.1), num_features=256, max_iter=5)
    assert grid.count() == 2 and M.labels_of(model) == ["A", "B", "C"]
    assert read.value <= 2 * len(rows)  # labels, then features
