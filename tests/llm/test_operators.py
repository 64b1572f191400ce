"""The training-data operators against brute force, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterset.llm import langid, mixing, neardup, packing, phrase_dedup, quality, toxicity
from utterset.llm.containment import band_count
from utterset.llm.decontaminate import decontaminate, leaks
from utterset.llm.license_scan import license_scan, templates
from utterset.llm.line_dedup import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, digest string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 12, 13, 60, 200, 40)]
    shared = words(rng, 30)
    texts = [*base, None, "", " \n\t ", base[4], base[4], base[5] + " tail", shared + " " + words(rng, 20),
             words(rng, 20) + "\n" + shared, words(rng, 9000), "Only line\nSHARED line\n\n shared line ", "shared line", base[0], "x", "x"]
    out = [(i, t, "en", "a" if i % 3 else None, 7, "d") for i, t in enumerate(texts)]
    return [*out, out[4], (None, base[4], None, "b", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    root = brute_components([r[1] for r in rows])
    ids = {}
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    want = {(r[0], len(shingles(r[1])), ids[c] if shingles(r[1]) else r[0]) for r, c in zip(rows, root, strict=True)}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_chains_and_open_buckets(spark):
    """Copies edited step by step: neighbours are linked, far ones are not; groups whose
    members are just below the threshold share buckets and stay apart."""
    rng = random.Random(11)
    texts = []
    for group in range(6):
        w = [f"g{group}x{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(25):
            w = list(w)
            for _ in range(rng.choice((1, 2, 3, 5))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        for _ in range(15):  # star-like edits of one base, similar to about 0.7 to 0.8
            v = list(w)
            for _ in range(rng.choice((2, 3, 4))):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_guests_do_not_depend_on_blocks(spark, monkeypatch):
    """Members of open buckets, dealt over one block and over many: the same guests, as brute force finds them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, neardup.HASHES, dtype=np.uint32)
    reps, members = [], []
    for i in range(30):
        sign = base.copy()
        other = rng.random(neardup.HASHES) < (0.05, 0.2, 0.7)[i % 3]
        sign[other] = rng.integers(0, 1 << 32, other.sum(), dtype=np.uint32)
        name = bytes([i])
        reps.append((name, 100 + i % 2 * 20, sign.astype("<u4").tobytes()))
        owner, size = (b"\xff", 9) if i < 9 else (name, 1)
        members += [(key, name, owner, size) for key in range(2)]
    reps_df = spark.createDataFrame(reps, "rep binary, n_shingles long, signature binary")
    members_df = spark.createDataFrame(members, "key long, m binary, class binary, size long")
    least, want = neardup.least_matches(0.75), set()
    for _, x, cx, sx in members:
        for _, y, cy, sy in members:
            a, b = (np.frombuffer(reps[r[0]][2], "<u4") for r in (x, y))
            passes = all((a[:n] == b[:n]).sum() >= low for n, low in zip(range(16, 241, 16), least))
            if (sx, cx) < (sy, cy) and passes:
                want.add((cy, sy, x))
    for block, pairs in ((4096, 1 << 16), (4, 7)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        got = [(bytes(r["host"]), r["host_size"], bytes(r["m"])) for r in neardup._guests(members_df, reps_df, 0.75).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_posterior_bounds_rise_with_the_number_of_hashes():
    least = neardup.least_matches(0.75)
    assert least == sorted(least) and all(m < 0.75 * 16 * (i + 1) for i, m in enumerate(least))


def test_line_dedup_equals_brute_force_on_both_paths(spark, docs, rows):
    from collections import Counter

    def keys(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    n = Counter(k for r in rows for k in set(keys(r[1])) if k)
    want = sorted(((r[0] is None, r[0] or 0), "\n".join(x for x, k in zip((r[1] or "").split("\n"), keys(r[1]), strict=True) if not k or n[k] < 2))
                  for r in rows)
    for limit in (1 << 20, 0):
        got = line_dedup(docs, min_docs=2, broadcast_keys=limit).collect()
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in got) == want
        assert all(r["lang"] in ("en", None) and r["digest"] in ("d", None) for r in got)


def test_line_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "a\nb"), (1, "A\na\nc"), (3, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup(df, min_docs=2, keep="first").collect()}
    assert got == {1: "A\nc", 2: "b", 3: ""}


def test_phrase_dedup_equals_brute_force(docs, rows):
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 12):
            if r[0] is not None:
                p = tuple(w[i:i + 13])
                first[p] = min(first.get(p, r[0]), r[0])
    want = []
    for r in rows:
        w, gone = WORD.findall(r[1] or ""), set()
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i:i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        want.append(((r[0] is None, r[0] or 0), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = phrase_dedup.phrase_dedup(docs).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["n_removed"], r["text"]) for r in got) == sorted(want)


def test_containment_finds_passages_and_short_items(spark, docs):
    item = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa."), (2, "tiny thing"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten")]
    items = spark.createDataFrame(item, "item_id long, text string")
    long = "noise " * 3000 + "ALPHA beta gamma delta epsilon; zeta eta theta iota kappa " + "noise " * 500
    texts = [(1, long), (2, "a tiny  THING here"), (3, "one two three four five six seven eight nine other"), (4, "one two three other five six"), (5, None), (5, "tiny thing"), (None, "tiny thing")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 3) for r in leaks(df, items).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 5): 0.833, (5, 2): 1.0, (None, 2): 1.0}
    assert {r["doc_id"] for r in decontaminate(df, items).collect()} == {4}
    assert leaks(df, items.limit(0)).count() == 0 and leaks(df.limit(0), items).count() == 0
    assert decontaminate(df, items.limit(0)).count() == len(texts)
    for size in (4, 50, 800):  # q items in a set of ``size`` have this similarity or more
        for q in (1, 3, 40, 700):
            least = 0.75 * q / (q + max(size, 0.75 * q) - 0.75 * q)
            assert least >= 1 or (1 - least) ** band_count(0.75, size, q) <= 1e-6 < (1 - least) ** (band_count(0.75, size, q) - 2)
    note = spark.createDataFrame([(7, "x\nReleased under the MIT License.\n")], "doc_id long, text string")
    assert [(r["license"], r["first_word"], r["last_word"]) for r in license_scan(note, templates(spark)).collect()] == [("MIT", 1, 5)]


def test_subset_sum_is_exact():
    rng = random.Random(3)
    for _ in range(40):
        sizes, counts = [rng.randrange(1, 30) for _ in range(6)], [rng.randrange(0, 4) for _ in range(6)]
        budget = rng.randrange(0, 120)
        reach = {0}
        for s, c in zip(sizes, counts, strict=True):
            reach = {x + k * s for x in reach for k in range(c + 1)}
        taken = mixing.subset_sum(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(t * s for t, s in zip(taken, sizes, strict=True)) == max(x for x in reach if x <= budget)


def test_mixing_meets_targets_and_is_stable(spark, docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [3, 1, 2], 1.5, 2), strict=True))
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in names:
        own = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and {r["target"] for r in own} == {goal[s]}
        whole = min(2, int(goal[s] / size[s]))
        reach = {0}
        for r in own:
            reach |= {x + r["size"] for x in reach}
        best = whole * size[s] + max(x for x in reach if whole < 2 and x <= round(goal[s]) - whole * size[s] or not x)
        assert sum(r["copies"] * r["size"] for r in own) == best and {r["copies"] for r in own} <= {0, 1, 2}
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["copies"]) for r in out) == sorted((str(r["doc_id"]), r["copies"]) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_best_fit_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths, cap = rng.integers(1, 65, 50), 64
        free, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fit = [c for c in free if c >= lengths[i]]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - lengths[i])
            else:
                free.append(cap - lengths[i])
                want.append(i)
        rows = packing.best_fit_decreasing(lengths, cap)
        assert len(rows) == len(want) and sorted(i for r in rows for i in r) == list(range(50))
        assert sorted(cap - sum(lengths[r]) for r in rows) == sorted(free)


def test_packing_round_trip(spark):
    import base64

    import tiktoken
    texts = [(1, "Hello  world!\n\n it's fine \x1c end"), (2, None), (3, ""), (4, "word " * 900), (5, "éß漢字 <|endoftext|>"), (5, "again"), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, open(packing.VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = []
    for r in packing.pack(df, packing.VOCABULARY, length=128).collect():
        ids, at = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(at) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["piece_starts"], strict=False):
            assert list(at[a:b]) == list(range(b - a))
            parts.append((str(doc), start, list(ids[a:b])))
    joined, seen = [], []
    for doc, start, ids in sorted(parts, key=lambda p: (p[0], p[1])):
        (seen if start else joined).append((doc, ids))
    full = {doc: ids for doc, ids in joined if doc != "5"}
    for doc, ids in seen:
        full[doc] = full[doc] + ids
    for doc, text in texts:
        want = plain.encode_ordinary(text or "") + [packing.END]
        assert (str(doc), want) in joined or full[str(doc)] == want


def test_language_id(spark):
    rng = random.Random(2)
    syll = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "nha", "ei"]}
    data = [(i, " ".join("".join(rng.choices(syll[x], k=3)) for _ in range(40)), x) for i in range(240) for x in [rng.choice(list(syll))]]
    data += [(1000, None, "aa"), (1001, "12 .. 3", "aa"), (1002, "", None), (None, "kalomi", "aa")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.learn(df.filter(langid.learnable()))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in data[:240])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.learn(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def test_quality_measures_and_risk(spark, docs, rows):
    got = quality.measure(docs).collect()
    want = []
    for r in rows:
        t = r[1] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        cover = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)} if len(wins) < 500 else None
        want.append((str(r[0]), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), cover))
    for a, b in zip(sorted(want, key=str), sorted(got, key=lambda r: str((str(r["doc_id"]), r["n_words"]))), strict=True):
        assert a[:5] == (str(b["doc_id"]), b["n_words"], b["word_chars"], b["n_symbols"], b["n_dup_lines"])
    rep = spark.createDataFrame([(1, "a b c d e f g h x a b c d e f g h i")], "doc_id long, text string")
    assert quality.measure(rep).first()["n_repeat_words"] == 16
    assert abs(quality.binomial_tail(3, 10, 0.5) - 176 / 1024) < 1e-12
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs, empty).filter("kept <> (not base_failed)").count() == 0


def test_quality_rejects_few_good_documents(spark):
    rng = random.Random(4)
    good = [(i, words(rng, 60), "en") for i in range(4000)]
    bad = [(10_000 + i, " ".join(w + "###" for w in words(rng, 60).split()), "en") for i in range(300)]
    labels = [(i, 1) for i, *_ in good[::2]] + [(i, 0) for i, *_ in bad[::2]]
    out = quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"),
                        spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["doc_id"] for r in out.filter("kept").collect()}
    assert sum(i in kept for i, *_ in good) >= 0.98 * len(good) and not any(i in kept for i, *_ in bad)


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        text = [words(rng, 8, 60) for _ in range(12)]
        toxic = i % 5 == 0
        if toxic:
            text[4] = "you utter badword" + str(i % 7) + " fool"
        rows.append((i, ". ".join(text) + ".", int(toxic)))
    rows += [(900, None, 1), (901, "", 0), (902, "!!", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.learn(df.filter(langid.learnable()))
    got = {r["doc_id"]: r for r in toxicity.score(df.drop("toxic"), weights).collect()}
    assert sum(got[i]["predicted"] == y for i, _, y in rows[:600]) >= 590
    assert all(any(s["sentence"] == 4 for s in got[i]["offending"]) for i, _, y in rows[:600] if y and got[i]["predicted"])
    assert [got[i]["score"] for i in (900, 901, 902)] == [0, 0, 0] and all(0 <= r["score"] <= 1 for r in got.values())


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline as P
    from utterset.llm.tables import read, stored

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    names, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == names and docs.count() > 0
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    ids = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert ids <= 2
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {i for r in packed for i in r["doc_ids"]} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_phrase_dedup_deals_a_hot_passage_evenly(spark, monkeypatch):
    """A passage that all documents hold: no bucket gets more phrases than its share, over
    one block and over many, and documents lose what brute force says."""
    rng = random.Random(8)
    hot = words(rng, 30)
    texts = [" ".join([f"a{i}x{j}" for j in range(20)] + [hot] + [f"b{i}x{j}" for j in range(20)]) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for size in (1 << 19, 500):
        monkeypatch.setattr(phrase_dedup, "BLOCK_PHRASES", size)
        monkeypatch.setattr(phrase_dedup, "BUCKET_PHRASES", 200)
        keyed = df.select(F.col("doc_id").alias("row_key"), "doc_id", "text")

        class All:
            @staticmethod
            def test(hashes):
                return np.ones(len(hashes), bool)
        cells = phrase_dedup._cells(phrase_dedup._blocks(keyed, All), 100)
        sizes = [r[0] for r in cells.groupBy("bucket").agg(F.sum("n")).select("sum(n)").collect()]
        assert max(sizes) <= 1.5 * sum(sizes) / len(sizes)
        got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in phrase_dedup.phrase_dedup(df).collect()}
        assert got == {i: (30, " ".join(t.split()[:20] + t.split()[50:])) if i else (0, t) for i, t in enumerate(texts)}


def test_phrase_dedup_tells_words_with_equal_low_bits_apart(spark):
    """Template lines that differ in a word whose hash has the same low 32 bits are no copies."""
    import pyarrow as pa

    from utterset.llm.wordops import hash_strings

    names = [f"id{i}" for i in range(400_000)]
    low = hash_strings(pa.array(names)).astype("<u4")
    order = np.argsort(low, kind="stable")
    same = np.flatnonzero(low[order][1:] == low[order][:-1])
    a, b = names[order[same[0]]], names[order[same[0] + 1]]
    texts = []
    for k in range(12):
        line = [f"t{k}x{j}" for j in range(12)]
        texts += [" ".join([*line[:k], x, *line[k:]]) for x in (a, b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"], r["text"]) for r in phrase_dedup.phrase_dedup(df).collect()} == {(i, 0, t) for i, t in enumerate(texts)}


def test_containment_counts_whole_documents(spark):
    """Items with repeated words, copies with insertions and parts far apart: the pairs that
    brute force finds by counting distinct shingles without windows."""
    rng = random.Random(21)
    phrase = words(rng, 6)
    table = f"{words(rng, 20, 10**6)} " + f"{phrase} " * 30 + words(rng, 20, 10**6)
    plain, pair = words(rng, 60, 10**6), (words(rng, 40, 10**6), words(rng, 40, 10**6))
    items = {1: table, 2: plain, 3: " ".join(pair), 4: "one two", 5: words(rng, 9, 10**6)}
    w = plain.split()
    texts = [f"{words(rng, k, 10**6)} {table} {words(rng, 300, 10**6)}" for k in (0, 37, 64, 101, 500)]
    texts += [" ".join([*w[:30], words(rng, k, 10**6), *w[30:]]) for k in (0, 40, 200, 3000)]
    texts += [f"{pair[0]} {words(rng, 900, 10**6)} {pair[1]}", f"{pair[1]} {words(rng, 900, 10**6)} {pair[0]}", pair[0], "a one two b", "one x two"]
    texts += [" ".join(x for x in w if rng.random() > part) for part in (0.02, 0.05, 0.06, 0.08, 0.2)]

    def sets(text, width):
        t = text.split()
        return {tuple(t[i:i + width]) for i in range(len(t) - width + 1)}
    want = set()
    for j, item in items.items():
        width = min(5, len(item.split()))
        s = sets(item, width)
        want |= {(i, j) for i, text in enumerate(texts) if len(s & sets(text, width)) / len(s) >= 0.75}
    got = leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(i, 1) for i in range(5)} | {(i, 2) for i in range(5, 9)} | {(9, 3), (10, 3), (12, 4)} <= want
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["containment"] == 1 and r["last_word"] - r["first_word"] == 219 for r in got if r["item_id"] == 1)


def test_license_scan_finds_the_license_lines_of_documents(spark):
    """Every line of the given documents that speaks of a license, and notices of other families."""
    from utterset.llm.tables import read

    lines = read(spark, "/root/testdata/sf0.01", "documents").select(F.explode(F.split("text", "\n")).alias("text")) \
        .filter("text rlike '(?i)licen[sc]e|all rights reserved|copyright|spdx|creative commons'").distinct()
    given = [r["text"] for r in lines.collect()]
    assert any("CC BY-NC" in x for x in given)
    other = {"// SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0-or-later", "SPDX-License-Identifier: MIT": "MIT",
             "The photos are licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
             "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0"}
    texts = [*given, *other]
    found = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates(spark)).collect()
    assert {r["doc_id"] for r in found} == set(range(len(texts)))
    assert {(texts[r["doc_id"]], r["license"]) for r in found} >= set(other.items())
