"""SimHash, whitening and conversation repair against brute force; batches of many slices."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from utterset.llm import containment, decontaminate, license_scan
from utterset.llm import conversation_repair as repair
from utterset.llm import neardup, phrase_dedup, quality, simhash, toxicity, trails, whitening, wordops

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- batches that are cut into several slices ------------------------------------------

def test_split_words_of_any_slice():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("AbC d\néß　xYZ") for _ in range(rng.randrange(30))) for _ in range(400)]
    whole = pa.array(texts)
    for low in (False, True):
        for at in range(0, 400, 4):
            found, offsets = wordops.split_words(whole.slice(at, 12), lower=low)
            found = found.to_pylist()
            want = [WORD.findall(lowered(t) if low else t or "") for t in texts[at:at + 12]]
            assert [found[a:b] for a, b in zip(offsets, offsets[1:])] == want


def test_results_do_not_depend_on_slices(spark, monkeypatch):
    """Every user of the word hashes over batches of one slice and of hundreds."""
    rng = random.Random(2)
    base = [" ".join(rng.choice(("Alpha", "beta", "GAMMA", "delta.", "x%d" % rng.randrange(300))) for _ in range(rng.randrange(60))) for _ in range(160)]
    rows = [(i, t if i % 9 else None, "en", int(i % 4 == 0)) for i, t in enumerate(base + base[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")

    def results():
        near = neardup.near_duplicates(df.select("doc_id", "text")).collect()
        phrases = phrase_dedup.phrase_dedup(df.select("doc_id", "text")).collect()
        good = quality.judge(df.select("doc_id", "text", "lang"), labels).collect()
        marks = toxicity.score(df.select("doc_id", "text"), toxicity.learn(df.select("doc_id", "text", "toxic"))).select("doc_id", "predicted").collect()
        prints = simhash.simhash_classes(df.select("doc_id", "text")).collect()
        return [sorted(map(str, x)) for x in (near, phrases, good, marks, prints)]

    one = results()
    monkeypatch.setattr(wordops.slices, "__defaults__", ("text", 400))
    for a, b in zip(one, results(), strict=True):
        assert a == b


# --- SimHash -----------------------------------------------------------------------------

def brute_fingerprint(text):
    w = WORD.findall(lowered(text))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def brute_classes(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((1, 2, 3, 4, 200, 900)))) for _ in range(60)]
    for t in texts[:40]:
        w = t.split()
        for k in (1, 2, 3):  # long texts with a few changed words: fingerprints a few bits apart
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [None, "", " \n", "A b C d", "a B c d", texts[0], " ".join(f"v{i}" for i in range(30_000))]
    rows = [(None if i == 7 else 1000 - i, t, "clash", "kept") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, note string").repartition(4)
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    got = simhash.simhash_classes(df).collect()
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_classes(prints)
    ids = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    assert len({c for c in roots}) < len(set(prints)) < len(texts)  # some links between different fingerprints
    want = sorted((str(r[0]), f"{p:016x}", str(ids.get(c)), "kept") for r, p, c in zip(rows, prints, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"]), r["note"]) for r in got) == want
    assert simhash.simhash_classes(df.limit(0)).count() == 0


def test_ball_links_join_what_all_pairs_join(spark):
    """Random fingerprints with neighbours at distances 1 to 4, a dense ball and chains."""
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << i) for i in range(64)} | {centre}
    for v in list(values)[:80]:
        for k in (1, 2, 3, 4):
            w = v
            for b in rng.sample(range(64), k):
                w ^= 1 << b
            values.add(w)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    links = [(r["a"], r["b"]) for r in simhash.ball_links(df).collect()]
    assert len(links) == len(set(links)) and all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        parent[y] = x
    assert [find(i) for i in range(len(values))] == brute_classes(values)


# --- whitening ---------------------------------------------------------------------------

def brute_whitening(vectors, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    w = ((n * x - sums) / n) @ v / np.sqrt(e)
    return n, e / (c * c).sum() * n, [sum(int(a) ** 2 for a in row) for row in n * x - sums], w


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((700, 24)) * np.linspace(1, 4, 24) + 3).astype(np.float32)
    v[100:150] = v[:50]
    bad = [(None, None), (1, [None] + [0.0] * 23), (2, [float("nan")] * 24), (3, [float("inf")] * 24), (4, [1.0, 2.0]), (5, [])]
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([(i + 10 if x is not None else i, x, "n") for i, x in rows] + [(*b, "n") for b in bad],
                               "vec_id long, embedding array<float>, whitened string").repartition(5)
    model = whitening.fit(df)
    out = whitening.transform(df, model)
    assert set(out.columns) == {"vec_id", "embedding", "deviation", "whitened"} and out.count() == 700
    n, explained, deviation, w = brute_whitening([r for _, r in rows], 16)
    got = whitening.by_component(out, model).collect()
    assert len(got) == 700 * 16 and model.n == n == 650 and model.identity_error < 1e-10
    value = np.zeros((700, 16))
    for r in got:
        value[r["vec_id"] - 10, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"] - 10]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] == model.identity_error
    sign = np.sign((value * w).sum(axis=0))
    assert np.abs(value * sign - w).max() < 1e-9


@pytest.mark.parametrize("kind", ["equal", "flat", "single", "few", "wide", "empty"])
def test_whitening_of_degenerate_vectors(spark, kind):
    """Equal eigenvalues, dimensions without variance, one vector, fewer vectors than
    dimensions, more dimensions than needed, none."""
    rng = np.random.default_rng(6)
    v = {"equal": np.concatenate([np.eye(6), -np.eye(6)]) * 4, "flat": np.column_stack([rng.standard_normal((50, 3)), np.ones((50, 4))]),
         "single": np.ones((3, 5)), "few": rng.standard_normal((4, 9)), "wide": rng.standard_normal((300, 70)) * 0.98 ** np.arange(70) * 9, "empty": np.zeros((0, 3))}[kind]
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    rank = {"equal": 6, "flat": 3, "single": 0, "few": 3, "wide": 16, "empty": 0}[kind]
    assert model.components.shape[1] == rank and model.identity_error < 1e-9
    rows = whitening.by_component(whitening.transform(df, model), model).collect()
    assert len(rows) == rank * len(v)
    if kind == "equal":
        assert np.allclose(model.eigenvalues, model.eigenvalues[0]) and abs(model.explained.sum() - 1) < 1e-12
    if kind == "wide":
        n, explained, _, w = brute_whitening(v.tolist(), 16)
        assert np.abs(model.explained / explained - 1).max() < 1e-9


def test_deviation_stays_exact_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    assert [int(v) for v in whitening._squares(x, 1 << 10, np.array([5, 7], np.int64)).to_pylist()] == \
        [sum(((1 << 10) * int(a) - s) ** 2 for a, s in zip(row, (5, 7))) for row in x]


# --- conversation repair ------------------------------------------------------------------

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute_audit(rows):
    """All audits with up to two inserts between rows, by exhaustive search."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = (1 << 30, "", [])

    def inserts(i, initials, cost, audit, lines):
        for k in range(3):
            walk(i, initials, cost, audit, lines)
            role = "assistant" if initials.endswith("u") else "user"
            initials, cost, audit, lines = initials + role[0], cost + 3, audit + "I", [*lines, (role, "")]

    def walk(i, initials, cost, audit, lines):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(best, (cost, audit, lines))
            return
        role, text = rows[i]
        inserts(i + 1, initials, cost + 4, audit + "D", lines)
        if faults[i] not in ("blank", "duplicate"):
            more = 3 * (faults[i] == "truncated")
            if role:
                inserts(i + 1, initials + role[0], cost + more, audit + "K", [*lines, (role, text)])
            for other in ("user", "assistant"):
                inserts(i + 1, initials + other[0], cost + 3 + more, audit + "R", [*lines, (other, text)])

    inserts(0, "", 0, "", [])
    return faults, *best


def check_reports(spark, rows, limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in brute_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, cost, audit, lines = brute_audit([r[2:] for r in own])
        turns = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                      illegal, cost, audit, sha)
    for limit in limits:
        repair.SEGMENT_ROWS = limit
        got = repair.report(repair.repair(repair.damage(df)), df).collect()
        assert len(got) == len(want)
        assert {r["conv_id"]: tuple(r)[1:] for r in got} == want
        assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture
def segment_rows():
    held = repair.SEGMENT_ROWS
    yield
    repair.SEGMENT_ROWS = held


def test_repair_equals_exhaustive_search(spark, segment_rows):
    """Short conversations of odd roles, faults, ties, null keys and repeated turns, in one
    segment and cut after every row or two."""
    rng = random.Random(7)
    rows = []
    for conv in range(70):
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None))
            text = rng.choice(("Fine.", "Fine.", "cut", "Really? ", " \t", None, "Ok!\n", "…"))
            rows.append((conv, rng.choice((turn, turn, turn + 5, None)), role, text))
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (200, None, "user", "x."), (201, 3, "user", "same."), (201, 3, "user", "same."), (201, 3, "assistant", "same.")]
    check_reports(spark, rows, (1024, 1, 2))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.repair(repair.damage(empty)), empty).count() == 0


def test_repair_of_a_hot_conversation(spark, segment_rows):
    """A conversation that spreads over many tasks, with thousands of equal rows, equals the
    programme run over it in one go."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(("user", "assistant")), rng.choice(("one.", "two", f"n{t}.", f"m{t}"))) for t in range(3000)]
    rows += [(1, 10**6, "user", "the same row")] * 2500 + [(c, t, "user" if t % 2 else "assistant", f"{c}.") for c in range(2, 30) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    repair.SEGMENT_ROWS = 100
    done = repair.repair(df)
    got = {r["conv_id"]: r for r in repair.report(done, df).collect()}
    assert done.filter("conv_id = 1").count() > 50
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1:])
    parts, plain, counts = repair.judged([r[2] for r in own], [r[3] for r in own], [1] * len(own), None)
    cost, trail = trails.finish(trails.advance(trails.start(), parts))
    lines, _ = trails.edited(plain, trail.text())
    assert (got[1]["cost"], got[1]["audit"], got[1]["duplicate"], got[1]["illegal"]) == (cost, trail.text(), counts["duplicate"], counts["illegal"])
    assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in lines).encode()).hexdigest()
    rows_left = repair.repaired_rows(done).filter("conv_id = 1").orderBy("seg", "place").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in rows_left] == lines


def test_audits_compare_as_their_texts(monkeypatch):
    """Also when all hashes collide."""
    for modulus in (trails.MODULUS, 1):
        monkeypatch.setattr(trails, "MODULUS", modulus)
        rng = random.Random(9)
        nodes = [trails.Trail()]
        for _ in range(400):
            nodes.append(trails.Trail(rng.choice(nodes[-60:]), rng.choice(("D", "I", "K", "KR", "KRD"))))
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert trails.smaller(a, b) == (a.text() < b.text())
        for node in nodes[::7]:
            assert [node.above(k).depth for k in range(node.depth + 1)] == list(range(node.depth, -1, -1))


# --- MinHash containment ------------------------------------------------------------------

def brute_contained(texts, items, threshold=0.75):
    def grams(t, width):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
    want = {}
    for j, item in items.items():
        width = min(5, len(item.split()))
        s = grams(item, width)
        for i, t in enumerate(texts):
            share = len(s & grams(t, width)) / len(s)
            if share >= threshold:
                want[i, j] = share
    return want


@pytest.mark.parametrize("windowed", [False, True])
def test_minhash_containment_finds_what_exact_counts_find(spark, windowed):
    """Long items, whole and cut to about the threshold, in documents that hold parts of up
    to forty items, so that sets are large and bands decide; short and repetitive items."""
    rng = random.Random(11)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = {j: words(rng.choice((30, 45, 70, 140, 300))) for j in range(60)}
    texts = []
    for _ in range(120):
        text = words(20)
        for j in rng.sample(range(60), rng.choice((1, 2, 15, 40))):
            w = items[j]
            kind = rng.randrange(4)
            if kind == 0:
                text += w
            elif kind == 1:  # a share of 0.7 to 0.9 of the words, in a row
                n = int(len(w) * rng.uniform(0.7, 0.9))
                text += w[:n]
            elif kind == 2:  # two halves with something between them
                text += [*w[:len(w) // 2], *words(rng.choice((1, 30, 500))), *w[len(w) // 2:]]
            else:
                text += [x if rng.random() > 0.04 else "changed" for x in w]
            text += words(rng.choice((0, 5, 100)))
        texts.append(" ".join(text))
    items = {j: " ".join(w) for j, w in items.items()} | {100: "three small words", 101: "a b c d e " * 20, 102: "solo"}
    texts += ["x three small words y", "a b c d e a b c d e a", "solo"]
    want = brute_contained(texts, items)
    used = []
    held = containment.band_count
    containment.band_count = lambda *a: used.append((held(*a), a[1])) or held(*a)
    try:
        got = containment.contained(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                    spark.createDataFrame(list(items.items()), "item_id long, text string"), "doc_id", "item_id", windowed=windowed).collect()
    finally:
        containment.band_count = held
    assert any(n < size for n, size in used)  # sets with more shingles than bands
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(got) == len(found) and found <= set(want) and len(want) > 500
    assert len(found) >= 0.99 * len(want)  # by the bands' setting all but one in a million
    assert all(0.75 <= r["containment"] <= want[r["doc_id"], r["item_id"]] + 1e-9 for r in got)


def test_leaky_documents_go_and_clean_rows_without_id_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, f"x {item} y", "a"), (None, "clean one", "b"), (None, None, "c"), (1, item, "d"), (1, "clean two", "e"), (2, "", "f"), (3, item, "g"), (3, item, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    for limit in (1 << 20, 0):
        assert sorted(r["item_id"] for r in decontaminate.decontaminate(docs, bench, broadcast_leaks=limit).collect()) == ["b", "c", "f"]


def test_license_scan_of_odd_rows(spark):
    """Null, empty and repeated documents, extra columns with clashing names, empty tables."""
    rows = [(1, None, "x"), (2, "", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (None, "All rights reserved.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((str(r["doc_id"]), r["license"]) for r in license_scan.license_scan(docs, license_scan.templates(spark)).collect())
    assert got == [("3", "MIT"), ("None", "All-Rights-Reserved")]
    assert license_scan.license_scan(docs.limit(0), license_scan.templates(spark)).count() == 0
    assert license_scan.license_scan(docs, license_scan.templates(spark).limit(0)).count() == 0


# --- quality rules ------------------------------------------------------------------------

def brute_cutoffs(rows, risk, error):
    """``rows``: (whether it chooses, stratum, quality, {rule: value}); the whole procedure in
    plain Python, with exact fractions in the binomial tail."""
    from fractions import Fraction
    from math import comb

    def tail(k, n):
        p = Fraction(risk).limit_denominator(1000)
        return sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
    strata, out = {r[1] for r in rows}, {}
    for s in strata:
        first = [r for r in rows if r[1] == s and r[0]]
        second = [r for r in rows if r[1] == s and not r[0] and r[2] == 1]
        order = sorted((sum(r[2] == 1 and r[3][rule] > c for r in first), -sum(r[2] == 0 and r[3][rule] > c for r in first), i, rule)
                       for rule, (_, grid) in quality.RULES.items() for i, c in enumerate(grid))
        path = []
        for *_, i, rule in order:
            path += [(rule, k) for k in range(i + 1) if (rule, k) not in path]
        held = {}
        for rule, i in path:
            tried = {**held, rule: float(quality.RULES[rule][1][i])}
            lost = sum(any(r[3][x] > c for x, c in tried.items()) for r in second)
            if not second or tail(lost, len(second)) > Fraction(error) / len(strata):
                break
            held = tried
        if held:
            out[s] = held
    return out


def test_certified_cutoffs_equal_brute_force(spark):
    rng = random.Random(12)
    rows, plain = [], []
    for i in range(2400):
        s, q = rng.choice(("en", "en", "de", None)), int(rng.random() < 0.8)
        n = rng.randrange(20, 200)
        chars = n * rng.randrange(4, 9 if q else 30)
        m = {"n_words": n, "word_chars": chars, "n_symbols": int(chars * max(0, rng.gauss(0.005 if q else 0.1, 0.02))), "n_dup_lines": rng.randrange(1 if q else 9),
             "n_repeat_words": rng.randrange(3), "n_lines": rng.randrange(1, 20), "n_upper": int(chars * rng.random() * 0.1)}
        rows.append((i, s, q, *m.values()))
        values = {rule: m[a] / m[b] for rule, (ratio, _) in quality.RULES.items() for a, b in [ratio.split(" / ")]}
        plain.append([None, s, q, values])
    rows += [(9999, "en", None, *rows[0][3:]), (9998, "fr", 1, *rows[0][3:])]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, quality int, " + ", ".join(f"{m} long" for m in quality.MEASURES)).repartition(4)
    chooses = {r["doc_id"]: r["c"] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(quality.CHOOSING)) == 0).alias("c")).collect()}
    for i, r in enumerate(plain):
        r[0] = chooses[i]
    plain.append([chooses[9998], "fr", 1, plain[0][3]])
    got = quality.cutoffs(df, 0.02, 0.05)
    assert got == brute_cutoffs(plain, 0.02, 0.05)
    assert set(got) == {"en", "de", None} and "symbols" in got["en"]
    assert quality.certified(got, ["en", "fr"])["fr"] == dict.fromkeys(quality.RULES)
    assert quality.cutoffs(df.limit(0)) == {}


def test_certified_rules_keep_the_risk(spark):
    """Good documents that no label was shown of: no stratum loses more than the risk, in
    nearly all of many draws."""
    rng = np.random.default_rng(13)
    broken = 0
    for _ in range(60):
        loss = np.sort(rng.beta(0.3, 6, 30))  # true rejection rates along a path
        n = 400
        rejected = (rng.random((n, 1)) < loss).sum(axis=0)
        steps = quality.certified_steps(rejected.tolist(), n, 0.02, 0.05)
        broken += steps > 0 and loss[steps - 1] > 0.02
    assert broken <= 8  # 3 are expected at most
    assert quality.certified_steps([0, 0], 0, 0.02, 0.05) == 0


def test_repeat_words_equal_brute_force(spark):
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(60))) for _ in range(60)] + [None, "", " ".join(["x"] * 40)]
    want = []
    for t in texts:
        w = WORD.findall(t or "")
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        want.append(len({j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}))
    got = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == dict(enumerate(want))
