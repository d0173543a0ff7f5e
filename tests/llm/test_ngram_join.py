import random
from collections import Counter

import numpy as np
import pytest

from anamnesis.llm import ngram_join as J

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed: int) -> list[tuple]:
    """Copies, near copies of all degrees (a crowd among them), shared passages, short and odd texts."""
    r = random.Random(seed)
    text = lambda n: [r.choice(WORDS) for _ in range(n)]
    rows, passage = [], text(30)
    for size, copies in ((90, 45), (60, 12), (150, 6), (14, 10), (7, 6), (6, 5), (400, 4)):
        base = text(size)
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, max(1, size // 40))):
                t[r.randrange(len(t))] = r.choice(WORDS)
            if r.random() < 0.3:
                t = t[: len(t) - r.randint(0, size // 8)]
            rows.append(" ".join(t))
    rows += [" ".join(passage + text(r.randint(0, 40))) for _ in range(30)]
    rows += [" ".join(text(r.randint(1, 6))) for _ in range(15)] + [None, "", "  \n", None, "One Two", "one\ttwo", "É é", "é É", "solo", "solo"]
    rows += rows[:5] + ["big " * 9000, " ".join(text(6000))]
    ids = r.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


def brute(rows: list[tuple]) -> list[tuple]:
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        old = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return sorted((i, len(sets[i]), label[i]) for i in ids)


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"rare": 3, "block": 8, "few": 4}), (3, {"rare": 2, "block": 6, "few": 2, "slices": True}), (4, {"rare": 1, "block": 16, "few": 1})])
def test_equals_all_pairs(spark, monkeypatch, seed, how):
    if how.pop("slices", False):  # what is too large to broadcast
        monkeypatch.setattr(J, "BROADCAST", 4)
        monkeypatch.setattr(J, "_PART_TOKENS", 2000)
        monkeypatch.setattr(J, "_SCAN_TOKENS", 3000)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as digest", "2 as component_id").repartition(3)
    got = J.join(docs, **how).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_every_linked_pair_shares_an_index_entry():
    """The index's promise, over random pairs near the threshold and random frequent tokens."""
    r = np.random.default_rng(0)
    met = 0
    for _ in range(6000):
        n = int(r.integers(1, 140))
        x = r.integers(0, 2**64, n, np.uint64)
        y = np.concatenate([x[: n - int(r.integers(0, n // 8 + 1))], r.integers(0, 2**64, int(r.integers(0, n // 8 + 1)), np.uint64)])
        x, y = np.unique(x), np.unique(y)
        c = len(np.intersect1d(x, y))
        if 100 * c < 80 * (len(x) + len(y) - c) or np.array_equal(x, y):
            continue
        met += 1
        share = r.random()
        frequent = set(np.concatenate([x, y])[r.random(len(x) + len(y)) < share].tolist())
        rare, keys, few = [], [], []
        for s in (x, y):
            mine = J.indexed(s, J.SHARE)
            rare.append(np.array([t for t in mine.tolist() if t not in frequent], np.uint64))
            keys.append({level: (need, set(k.tolist())) for level, need, k in J.combinations(s, rare[-1], 80)})
            few.append(len(rare[-1]) <= J.slack(len(s), 80))
        enough = [len(keys[0][k][1] & keys[1][k][1]) >= max(keys[0][k][0], keys[1][k][0]) for k in keys[0].keys() & keys[1].keys()]
        assert set(rare[0].tolist()) & set(rare[1].tolist()) or (all(few) and any(enough))
    assert met > 2000


def test_size_classes_hold_linked_sizes():
    for n in range(1, 5000):
        a, b = J.size_class(n, 80), J.size_class(100 * n // 80, 80)
        assert a <= b <= a + 1
        apart, groups = J.dealt(a, 80)
        assert apart >= (n + 100 * n // 80) // 9 and groups > apart


def test_a_crowd_is_joined_by_its_middle(spark):
    """Twice and four times as many near copies of one text need twice and four times as many verifications, and no blocks."""
    r = random.Random(5)
    base = [f"{r.random()}" for _ in range(120)]
    done = []
    for n in (100, 200, 400):
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            t = list(base)
            t[r.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(t)))
        seen = []
        real, J._verified = J._verified, lambda pairs, *a, f=J._verified: (seen.append(pairs.count()), f(pairs, *a))[1]
        blocks, J._open_links = J._open_links, None
        try:
            got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        finally:
            J._verified, J._open_links = real, blocks
        assert {x.component_id for x in got} == {0}
        done.append(sum(seen) / n)
    assert max(done) < 12 and done[2] < 1.5 * done[0] + 1


def test_ids_on_rows_with_different_texts(spark):
    a, b, c = " ".join(WORDS[:50]), " ".join(WORDS[100:150]), " ".join(WORDS[200:250])
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b + " tail"), (8, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in J.join(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8)]
    assert sorted((r.doc_id, r.text) for r in J.keep_one(docs).collect()) == [(3, a), (5, b), (8, c)]


def test_rows_that_are_kept(spark):
    a, b = " ".join(WORDS[:50]), " ".join(WORDS[100:150])
    rows = [(5, a, "x"), (2, a + " tail", "y"), (5, a, "w"), (9, b, None), (None, b, "z"), (None, "alone here", "z"), (11, None, "q"), (12, None, "q"), (13, "", None), (14, c := " ".join(WORDS[300:320]), "f"), (14, c, "e"), (None, b.upper(), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as _h", "text as key", "1 as key_", "source as row")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == Counter([2, 9, None, 11, 12, 13, 14])
    assert [r.source for r in got if r.doc_id == 14] == ["e"] and all(r.text == r.key for r in got)
    assert sorted(J.keep_one(docs.where("doc_id in (2, 9, 11, 12)")).columns) == sorted(docs.columns)
    assert J.keep_one(docs.limit(0)).count() == 0 and J.join(docs.limit(0)).count() == 0
