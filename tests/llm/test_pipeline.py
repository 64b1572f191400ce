"""corpus_pipeline.run against plain Python versions of its stages, on planted documents."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from utterset.llm import mixing
from utterset.llm.tables import read, stored

from .test_operators import WORD, brute_components
from .test_round3 import brute_contained

SYLLABLES = {"aa": ["ka", "lo", "mi", "pe", "tu"], "bb": ["sch", "ung", "ei", "acht", "ze"], "cc": ["ção", "nha", "lh", "ões", "qui"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents and benchmark: texts of three languages, exact and near
    copies, chains of them, leaks, rows without text, letters or id, equal rows."""
    rng = random.Random(31)

    def text(lang, n):
        return [("".join(rng.choices(SYLLABLES[lang], k=3))) + rng.choice(("", "", ".", ",")) for _ in range(n)]
    rows, items = [], {j: " ".join(text("aa", 40)) for j in range(4)}

    def add(words, lang, source, doc_id=-1):
        t = words if words is None or isinstance(words, str) else " ".join(words)
        rows.append((len(rows) * 3 + 1 if doc_id == -1 else doc_id, t, lang, source, len(t or "")))
    for k in range(150):
        lang = rng.choice("abc") * 2
        w = text(lang, rng.choice((30, 60, 120)))
        source = rng.choice(("web", "web", "web", "books", None))
        add(w, lang, source)
        if k % 10 == 0:
            add(list(w), lang, source)
        if k % 10 == 1:
            for _ in range(3):  # a chain of near copies
                w = list(w)
                w[rng.randrange(len(w))] = "x".join(rng.choices(SYLLABLES[lang], k=2))
                add(w, lang, source)
        if k % 25 == 3:
            add([*w, *items[k % 4].split(), *w[:9]], lang, source)
    for t in (None, "", " \n", "12 34 !!", "%% 77"):
        add(t, "aa", "web")
    for _ in range(3):
        add("one row without an id " + " ".join(text("aa", 40)), "aa", "books", None)
    add(rows[0][1], "aa", "web", None)
    rows.append(rows[5])
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def brute_stages(rows, items):
    """What language, near_duplicates and decontamination leave."""
    left = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    yield left
    roots, best = brute_components([r[1] for r in left]), {}

    def order(r):
        return r[0] is None, r[0] or 0
    for r, c in zip(left, roots, strict=True):
        best[c] = min(best.get(c, order(r)), order(r))
    once, seen = [], set()
    for r, c in zip(left, roots, strict=True):
        if order(r) == best[c] and c not in seen:
            seen.add(c)
            once.append(r)
    yield once
    leaky = {i for i, _ in brute_contained([r[1] for r in once], items)}
    yield [r for i, r in enumerate(once) if i not in leaky]


def test_stages_equal_plain_python(spark, planted):
    folder, rows, items = planted
    docs = read(spark, folder, "documents")
    for (name, stage), want in zip(P.STAGES, brute_stages(rows, items), strict=False):
        docs = stored(stage(spark, docs, folder), name)
        got = [tuple(r) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(str, got)) == sorted(map(str, want)), name
    clean = got
    mixed = Counter(tuple(r) for r in P.STAGES[3][1](spark, docs, folder).collect())
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    sizes = {}
    for r in clean:
        sizes.setdefault(r[3], []).append(len(WORD.findall(r[1])))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([sum(sizes[s]) for s in names], [3, 1, 2], 1.5, 2)
    for s, goal in zip(names, goals, strict=True):
        whole = min(2, int(goal / sum(sizes[s])))
        reach = {0}
        for n in sizes[s]:
            reach |= {x + n for x in reach}
        want = whole * sum(sizes[s]) + max(x for x in reach if (whole < 2 and x <= round(goal) - whole * sum(sizes[s])) or not x)
        assert sum(n * len(WORD.findall(r[1])) for r, n in mixed.items() if r[3] == s) == want


def test_run_packs_what_the_stages_leave(spark, planted):
    folder, rows, items = planted
    *_, clean = brute_stages(rows, items)
    packed = P.run(spark, folder).collect()
    found = Counter()
    for r in packed:
        ids, starts = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 2048 and r["n_tokens"] == starts[-1]
        found.update(d for d, start in zip(r["doc_ids"], r["piece_starts"], strict=True) if start == 0)
    assert set(found) <= {r[0] for r in clean} and max(n for d, n in found.items() if d is not None) <= 2
    assert len(found) > 0.6 * len(clean)


def test_near_duplicate_stage_on_odd_tables(spark):
    """An empty table, one of nulls, columns named like those that the operator adds."""
    stage = dict(P.STAGES)["near_duplicates"]
    schema = "doc_id long, text string, kept string, signature int, digest int"
    rows = [(1, None, "a", 1, 2), (2, None, "b", 1, 2), (None, "", "c", 1, 2), (None, None, "d", 1, 2), (5, "t " * 9, "e", 1, 2), (5, "t " * 9, "e", 1, 2), (4, "T " * 9, "f", 0, 0)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r["kept"] for r in stage(spark, df, "").collect()) == ["a", "b", "c", "d", "f"]
    assert stage(spark, df.limit(0), "").count() == 0 and stage(spark, df, "").columns == df.columns
