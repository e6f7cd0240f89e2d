"""Minhash near duplicates against all pairs: large groups, small sets, odd rows."""

import numpy as np
import pytest

from martflow.llm import minhash


def word_sets(docs):
    split = {i: (t or "").lower().split() for i, t in docs.items()}
    return {i: {" ".join(w[a:a + 3]) for a in range(max(1, len(w) - 2))} if w else set() for i, w in split.items()}


def all_pairs(sets):
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1:]:
            a, b = sets[x], sets[y]
            if a and 20 * min(len(a), len(b)) >= 17 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((top(x), top(y)))
                label[high] = low
    return {i: top(i) for i in sets}


def near(spark, docs, **how):
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, **how).collect()}


@pytest.fixture(scope="module")
def docs():
    """Groups with and without their original, near the limit, chains, passages, tiny texts."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for g, changes in enumerate((3, 5, 9)):
        base = word(150)
        for _ in range(50):
            copy = list(base)
            for at in rng.integers(0, 150, rng.integers(0, changes)):
                copy[at] = f"n{rng.integers(0, 10 ** 9)}"
            texts.append(copy)
    passage = word(80)
    texts += [word(int(rng.integers(4, 40))) + passage for _ in range(60)]
    chain = word(120)
    for _ in range(30):   # each a small step from the last, far from the first
        chain = list(chain)
        chain[int(rng.integers(0, 120))] = f"c{rng.integers(0, 10 ** 9)}"
        texts.append(chain)
    small = word(12)
    texts += [small[:rng.integers(1, 13)] + word(int(rng.integers(0, 2))) for _ in range(60)]
    texts += [["Same", "TEXT", "here", "again"]] * 40
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("stars", [3, 1])
def test_groups_against_all_pairs(spark, docs, stars, monkeypatch):
    monkeypatch.setattr(minhash, "EDGES", 7)   # centres with several shares
    sets = word_sets(docs)
    want = all_pairs(sets)
    assert near(spark, docs, stars=stars) == {i: (len(sets[i]), want[i], want[i] == i) for i in docs}


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words for the same id"), (2, None), (3, ""), (None, "a b c d"),
            (None, None), (4, " \t\n"), (5, long), (6, long + " end"), (7, "Two words"), (8, "two WORDS"), (9, "words two"),
            (None, "nameless text of some words"), (None, "nameless text of some words")]
    frame = spark.createDataFrame([(*r, 1, 2, 3, True) for r in rows],
                                  "doc_id long, text string, cls long, th long, hub long, kept boolean")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()
                 if r.component_id is not None)
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True),
                   (4, 0, 4, True), (5, 59998, 5, True), (6, 59999, 5, False), (7, 1, 7, True), (8, 1, 7, False),
                   (9, 1, 9, True)]
    rest = [r for r in minhash.near_duplicates(frame).collect() if r.component_id is None]
    assert sorted(r.n_shingles for r in rest) == [0, 3, 3] and all(r.kept and r.doc_id is None for r in rest)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_sketches_agree_like_the_sets():
    rng = np.random.default_rng(4)
    for size in (12, 100, 2000):
        same = []
        for _ in range(60):
            v = np.unique(rng.integers(0, 2 ** 63, 2 * size).astype(np.uint64))
            shared = 2 * size - size // 4
            a, b = v[rng.permutation(len(v))[:shared]], v
            a = np.sort(a)
            same.append((minhash.sketch(a) == minhash.sketch(b)).mean())
        assert abs(np.mean(same) - shared / (2 * size)) < 0.05
