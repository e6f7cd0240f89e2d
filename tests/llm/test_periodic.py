"""Periodic runs against a scan of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from martflow.llm import periodic, queries

SMALL = "/root/testdata/sf0.001"
ROWS = [(1, "a b " * 10), (1, "a b " * 10), (2, None), (3, ""), (None, "x " * 30), (4, " \n\t"), (5, "one two three"),
        (6, " ".join(f"w{i % 1000}" for i in range(5000)) + " tail"), (7, "\x1cé " * 12 + "\x0b"), (8, "y " * 11)]


def every_lag(words, least=12):
    """(start, length, period) of all runs, by every lag."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words])
    found = {}
    for q in range(1, len(x) // 2 + 1):
        edge = np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_against_every_lag(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, SMALL).collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows) > 10
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        runs = every_lag(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (
            (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
        listed = "".join("%d,%d,%d\n" % x for x in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(without_repeats(words, runs).encode()).hexdigest()


@pytest.mark.parametrize("few_pairs", [0, 50_000])
def test_finder_against_every_lag(monkeypatch, few_pairs):
    monkeypatch.setattr(periodic, "FEW_PAIRS", few_pairs)
    rng = random.Random(5)

    def text():
        words = [rng.randrange(rng.choice([1, 2, 5, 1000])) for _ in range(rng.randrange(600))]
        for _ in range(rng.randrange(4) if words else 0):
            a, p = rng.randrange(len(words)), rng.choice([3, 40, 100, 300])
            part = words[a:a + p]
            words[a:a + p] = [part[i % len(part)] for i in range(len(part) + rng.randrange(600))]
        return words

    for _ in range(60):
        texts, x, bounds = [text() for _ in range(3)], [], [0]
        for i, words in enumerate(texts):
            x += [*words, 10_000 + i]
            bounds.append(len(x))
        got = [tuple(r) for r in periodic.find_runs(np.array(x, np.int64), np.array(bounds)).tolist()]
        want = [(s + b, s + b + n, q) for b, words in zip(bounds, texts) for s, n, q in every_lag(words)]
        assert sorted(got) == sorted(want)


def test_long_texts_of_few_words():
    for words, want in (([0] * 100_000, 1), (([0] * 100 + [1]) * 1000, 1001), (list(range(30_000)) * 3, 1)):
        x = np.array([*words, 10 ** 6])
        assert len(periodic.find_runs(x, np.array([0, len(x)]))) == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, runs int, kept string")
    rows = periodic.periodic_runs(docs).collect()
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in rows)
    assert got[1:3] == [(1, 20, [(0, 20, 2)], "a b")] * 2 and got[0] == (0, 30, [(0, 30, 1)], "x")
    assert [g for g in got if g[0] in (2, 3, 4)] == [(i, 0, [], "") for i in (2, 3, 4)]
    assert got[6][1:] == (3, [], "one two three")
    assert got[7][1:] == (5001, [(0, 5000, 1000)], " ".join(f"w{i}" for i in range(1000)) + " tail")
    assert got[8][1:] == (12, [(0, 12, 1)], "\x1cé") and got[9][1:] == (11, [], " ".join("y" * 11))
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
