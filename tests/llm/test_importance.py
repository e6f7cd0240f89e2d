"""Importance resampling: odd rows, selection over many blocks, order of ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martflow.llm import importance
from martflow.llm.common import Layers

ROWS = [(1, "a b c " * 10), (1, "a b c " * 10), (2, None), (3, ""), (None, "d " * 25), (None, "d " * 25), (4, " \n.,"),
        (5, "É é A a " * 20), (6, " ".join(f"w{i}" for i in range(50_000))), (7, "x " * 19), (8, "x " * 20)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("s", 1, 2.0, 3, 4)
    return spark.createDataFrame([(*r, *extra) for r in ROWS],
                                 "doc_id long, text string, row string, rank int, score double, tie long, place long")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c"), (None, None), (2, "")], "item_id long, text string")


def test_odd_rows(docs, items):
    rows = importance.ranked(docs, items, draw=50).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].n_features for i in (1, 2, 3, 4, 5, 6, 7)] == [30, 0, 0, 0, 80, 50_000, 19]
    assert by_id[2].weight == by_id[3].weight == 0 and by_id[2].score == importance.noise(2, importance.SEED)
    assert all(by_id[i]["rank"] is None for i in (2, 3, 4, 7))
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == [1, 2, 3]   # half of seven rows
    order = sorted((r for r in rows if r.n_features >= 20), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.score) for r in drawn] == [(r.doc_id, r.score) for r in order[:3]]


def test_drawn_rows_are_whole(docs, items):
    kept = importance.resampled(docs, items, draw=100)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 5, 6, 8]


def test_empty_tables(docs, items):
    assert importance.ranked(docs.limit(0), items).count() == 0
    assert importance.resampled(docs.limit(0), items).count() == 0
    assert importance.ranked(docs, items.limit(0)).where("rank is not null").count() == 0   # a tenth of seven


def test_cutoff_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    keys = [(int(s), int(t), i) for i, (s, t) in enumerate(zip(rng.integers(0, 40, 3000), rng.integers(0, 50, 3000)))]
    frame = Layers(spark, "keys").write(spark.createDataFrame(keys, "score long, tie long, place long").repartition(7))
    order = sorted((-s, t, p) for s, t, p in keys)
    for draw in (1, 2, 777, 2999, 3000):
        for block in (1, 20, 5000):
            if block > 1 or draw == 777:
                assert importance.cutoff(frame, draw, Layers(spark, "cut"), block) == order[draw - 1]
    assert importance.cutoff(frame, 0, Layers(spark, "cut")) is None
    assert importance.cutoff(frame, 3001, Layers(spark, "cut")) is None


def test_longer_features():
    assert len(importance.features(b"One two, THREE", 2, 1000)[0]) == 5
    same = [importance.features(t, 3, 1000)[0].tolist() for t in (b"one two three", b"ONE-two\tthree!")]
    assert same[0] == same[1] and importance.features(b"", 2, 10)[1] == 0


def test_gain_favours_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(["news" if i % 5 else "goal"] * 30)) for i in range(500)], "doc_id long, text string")
    drawn = importance.resampled(docs, spark.createDataFrame([("goal goal",)], "text string"))
    assert drawn.count() == 50 and drawn.where(F.col("text").startswith("goal")).count() == 50
