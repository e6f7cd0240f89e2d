"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from martflow.llm import (decision_list, decontam, hash_tree, licenses, line_dedup, ngram_join, packing, pii, queries,
                          toxicity, warc)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, cls long, key long, "
          "shard int, w string, score double, th long, _id long, label long")
LONG = " ".join(f"word{i} and" for i in range(30_000)) + " " + "9" * 20_000 + " " + "a" * 50_000
MAIL = "mail a.b@c-d.example now"
ROWS = [(1, MAIL), (1, MAIL), (2, None), (3, ""), (None, MAIL), (None, None), (4, " \n\t"), (5, LONG), (6, LONG + " x"),
        (7, "one two three"), (8, "ONE two\x0bthree"), (8, "other text here"), (9, "😀 +1 (123) 456-7890 😀 1.2.3.4")]
EXTRA = (None, "s", 1, 2, 3, 4, 5, "x", 0.5, 6, 7, 8)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (5, 0, 1), (7, 1, 0), (7, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, "..."), (None, MAIL), (4, "word0 " * 12), (4, "one two")],
                                 "item_id long, text string")


def _all(docs, labels, items):
    rules = decision_list.fit(docs, labels)
    yield "quality", decision_list.judged(docs, rules), len(ROWS)
    yield "quality rows", decision_list.keep_good(docs, rules), None
    yield "lines", line_dedup.drop_boilerplate(docs, F.col("source"), min_pages=2), len(ROWS)
    yield "shards", hash_tree.sharded(docs, hash_tree.even_tree(40)), len(ROWS)
    yield "join", ngram_join.near_duplicates(docs), len(ROWS)
    yield "one of each", ngram_join.keep_one(docs), None
    yield "toxicity", toxicity.scored(docs, toxicity.fit(docs, labels)), len(ROWS)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))
    yield "archive", warc.archived(pages), len(ROWS)
    yield "packing", packing.packed(docs, queries.TOKENIZER), None
    yield "licenses", licenses.license_matches(docs), 0
    yield "pii", pii.personal_data(docs), len(ROWS)
    yield "windows", decontam.contamination(docs, items), len(ROWS)
    yield "clean rows", decontam.drop_contaminated(docs, items), None


def test_odd_rows(docs, labels, items):
    found = {}
    for name, frame, n in _all(docs, labels, items):
        found[name] = frame.collect()
        assert n is None or len(found[name]) == n, name
    assert found["lines"][0].asDict()["lang"] is None
    join = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found["join"] if r.doc_id in (1, 3, 5, 6, 7))
    assert join == [(1, 1, 1), (1, 1, 1), (3, 0, 3), (5, 59998, 5), (6, 59999, 5), (7, 1, 7)]
    assert {r.component_id for r in found["join"] if r.doc_id == 8} == {7, 8}
    assert sorted(r.component_id or 0 for r in found["join"] if r.doc_id is None) == [0, 1]
    assert sum(r.doc_id == 1 for r in found["one of each"]) == 1
    assert {r.doc_id for r in found["one of each"]} == {1, 2, 3, None, 4, 5, 7, 8, 9}
    shards = {}
    for r in found["shards"]:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    spans = {r.doc_id: pii_text for r in found["pii"] for pii_text in [[tuple(s) for s in r.spans]]}
    assert spans[9] == [(1, 22, 29), (3, 2, 19)] and spans[1] == [(0, 5, 20)] and spans[3] == spans[2] == []
    hits = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found["windows"]}
    assert {(1, 7, 7, ("",)), (2, 0, 0, ()), (7, 3, 2, ("1", "4")), (4, 0, 0, ())} <= hits
    assert not {r.doc_id for r in found["clean rows"]} & {1, 7}
    # Ids that a hit and a clean text share lose the hit one alone.
    assert [(r.doc_id, r.text) for r in found["clean rows"] if r.doc_id in (8, None)] == [(None, None), (8, "other text here")]
    assert {r.doc_id for r in found["packing"]} == {r[0] for r in ROWS}
    assert all(0 <= r.score <= 1 for r in found["toxicity"])


def test_empty_tables(docs, labels, items):
    for name, frame, _ in _all(docs.limit(0), labels.limit(0), items.limit(0)):
        assert frame.count() == 0, name


def test_rows_keep_their_columns(docs, labels, items):
    rules = decision_list.fit(docs, labels)
    assert decision_list.keep_good(docs, rules).columns == docs.columns
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert decontam.drop_contaminated(docs, items).columns == docs.columns


def test_boilerplate(spark):
    rows = [(i, "s", f"Menu \nbody {i}\n\nmenu") for i in range(20)] + [(99, None, "Menu\nx"), (98, "s", None)]
    pages = spark.createDataFrame(rows, "page_id long, site string, text string")
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(pages, F.col("site")).collect()}
    assert (got[3].text, got[3].n_lines, got[3].n_dropped) == ("body 3\n", 4, 2)
    assert (got[99].text, got[99].n_dropped) == ("Menu\nx", 0)
    assert (got[98].text, got[98].n_lines) == (None, 0)


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"write to tel: +1 (555) 000-{1000 + i} today") for i in range(12)]
    rows += [(100, "write to tel: 555-000-4321 today"), (101, "the sum 555-000-4321 is a number")]
    rows += [(200 + i, f"number {i} today") for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[100]] == [(3, 14, 26)]
    assert got[101] == [] and got[200] == []


def test_license_text(spark):
    rows = [(1, "Intro\nReleased under the MIT license!\n"), (2, licenses.TEMPLATES["mit"].replace(", ", ",\n")),
            (3, "Released under another agreement")]
    got = {(r.doc_id, r.unit, r.template) for r in
           licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "line", "mit-short"), (2, "text", "mit")} <= got and not any(g[0] == 3 for g in got)


def test_rules_are_ordered_conditions():
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.random(900), rng.random(900)
    rules = decision_list.learn({"n_words": x, "top_share": y}, (x > 0.8) | (y < 0.1))
    assert len(rules) >= 2
    bad = np.zeros(900, bool)
    for rule in rules:
        bad |= np.logical_and.reduce([c.holds({"n_words": x, "top_share": y}) for c in rule])
    assert (bad == ((x > 0.8) | (y < 0.1))).mean() > 0.97
    assert decision_list.learn({"n_words": x}, np.zeros(900, bool)) == []
