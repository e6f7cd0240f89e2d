"""Discovered identifiers and secrets, contexts between marks, texts of many matches."""

import re

from martflow.llm import pii


def spans(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii.personal_data(frame).collect()}


def test_secrets_behind_a_pattern(spark):
    keys = [f"{i:x}a" * 20 for i in range(8)]
    rows = [(i, f'lorem ipsum token = "{k}" dolor') for i, k in enumerate(keys)]
    rows += [(20, f"TOKEN='{keys[0].upper()}'!! sit"), (21, 'x token: "Ab3dEf6hIj9kLmNo2qRs"'), (22, "token token-free"),
             (23, "sha " + "ab12" * 10), (24, 'name = "Ab3dEf6hIj9kLmNo2qRs"'), (25, "été token=abcdefghijklmnop1234 é")]
    got = spans(spark, rows)
    assert all(got[i] == [("secret", 21, 61)] for i in range(8))
    assert got[20] == [("secret", 7, 47)] and got[21] == [("secret", 10, 30)] and got[25] == [("secret", 10, 30)]
    assert got[22] == got[23] == got[24] == []


def test_contexts_are_bare_words(spark):
    """Quotes, colons and line ends between a word and what follows make no other pattern."""
    rows = [(i, f'"phone": "+1 (555) 000-{1000 + i}",') for i in range(6)]
    rows += [(10, "Phone = '555-000-4321'"), (11, "the phone,\n555-000-4322"), (12, "sum 555-000-4323")]
    got = spans(spark, rows)
    assert got[10] == [("phone", 9, 21)] and got[11] == [("phone", 11, 23)] and got[12] == []


def test_a_page_of_figures(spark):
    """100,000 numbers in one text, and positions behind them, in code points."""
    text = "é " + " ".join(f"{100 + i % 900}-{2000 + i}" for i in range(100_000)) + " mail a.b@c.de"
    rows = [(i, f"tel: +1 (555) 000-{1000 + i}") for i in range(6)] + [(10, text), (11, text + " tel: 555-000-4321")]
    got = spans(spark, rows)
    at = text.index("a.b@c.de")
    assert got[10] == [("email", at, at + 8)]
    assert got[11][0] == ("email", at, at + 8) and got[11][1:] == [("phone", len(text) + 6, len(text) + 18)]


def test_positions_of_many_blocks(spark):
    text = " ".join(f"m{i}@x{i}.de é" for i in range(500))
    want = [("email", m.start(), m.end()) for m in re.finditer(r"m\d+@x\d+\.de", text)]
    assert spans(spark, [(1, text), (2, None), (3, "")]) == {1: want, 2: [], 3: []}
