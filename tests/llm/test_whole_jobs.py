"""What the text operators once left out: cases beyond the test tables."""

import os
import random
import textwrap

from pyspark.sql import functions as F

from martflow.llm import licenses, line_dedup, minhash, ngram_join, pii
from martflow.llm.common import Layers


def test_lines_on_a_hundredth_of_a_large_site(spark):
    rows = [(i, "s", f"body {i}\nfoot" if i % 80 == 0 else f"body {i}") for i in range(400)]
    rows += [(1000 + i, "s", "a copied text\nof two lines") for i in range(2)]
    rows += [(2000 + i, "t", f"body {i}\nfoot" if i < 3 else f"body {i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, site string, text string")
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(pages, F.col("site")).collect()}
    assert (got[80].text, got[80].n_dropped) == ("body 80", 1) and (got[2001].text, got[2001].n_dropped) == ("body 1", 1)
    assert got[1].n_dropped == 0 and got[1000].text == got[1001].text == "a copied text\nof two lines"


def test_notices_between_a_line_and_a_text(spark):
    wrap = lambda name, mark: "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[name], 70))
    code = "\n".join(f"value_{i} = of the software {i}" for i in range(300))
    short = licenses.TEMPLATES["mit-short"]
    rows = [(1, f"{code}\n{wrap('mit', ' * ')}\n{code}"), (2, f"{code} {short} {code}"),
            (3, f"{code}\n{wrap('gpl-3.0-notice', '# ')}\n{code}\n{wrap('gpl-3.0-notice', '')}\n{code}"),
            (4, f"a\n{short}\n{code}"), (5, code), (6, f"{code}\n{wrap('bsd-3-clause', '// ')}\n{code}"),
            (7, f"Released under the\nMIT License.\n{short}\n{code}")]
    got = [(r.doc_id, r.unit, r.line_no, r.template) for r in
           licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    lines = len(textwrap.wrap(licenses.TEMPLATES["gpl-3.0-notice"], 70))
    assert sorted(got) == [
        (1, "window", 300, "mit"), (2, "window", 299, "mit-short"), (3, "window", 300, "gpl-3.0-notice"),
        (3, "window", 600 + lines, "gpl-3.0-notice"), (4, "line", 1, "mit-short"), (6, "window", 300, "bsd-3-clause"),
        (7, "line", 2, "mit-short"), (7, "window", 0, "mit-short")]


def test_discovered_identifiers_make_patterns(spark):
    rows = [(i, f"write to tel: +1 (555) 000-{1000 + i} today") for i in range(12)]
    loose = [f"555-000-{4000 + i}" for i in range(6)]
    rows += [(100 + i, f"write to tel: {x} today") for i, x in enumerate(loose)]
    rows += [(200 + i, f"send a fax: {x} today") for i, x in enumerate(loose)]
    rows += [(300, "send a fax: 555-777-9999 today"), (301, "the sum 555-777-9998 is a number")]
    rows += [(400 + i, f"ring cell: +1 (555) 111-{2000 + i}") for i in range(3)]      # too few seeds alone
    rows += [(410 + i, f"ring cell: {x}") for i, x in enumerate(loose[:3])] + [(420, "ring cell: 555-222-3333")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in
           pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [(3, 14, 26)] and got[200] == [(3, 12, 24)]
    assert got[300] == [(3, 12, 24)] and got[301] == [] and got[420] == [(3, 11, 23)]


def test_keep_one_leaves_only_the_layer_it_reads(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "Layers", lambda *a: made.append(Layers(*a)) or made[-1])
    copies = [(i, f"one two three four five six seven eight nine ten {'x' if i % 2 else 'y'}{i // 4}") for i in range(12)]
    docs = spark.createDataFrame([*copies, copies[0]], "doc_id long, text string")
    kept = ngram_join.keep_one(docs)
    assert made[0].n > 2 and len(os.listdir(made[0].root)) == 1
    assert kept.count() == kept.distinct().count() and kept.count() <= 12


def test_equal_texts_write_their_signatures_once():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(200))
    docs = lambda n: pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([7] * n, pa.int64()), pa.array([text] * n)], ["doc_id", "th", "text"])
    rows = lambda n: sum(b.num_rows for b in ngram_join._rows(iter([docs(n)])))
    assert rows(50) == rows(1) + 49


def test_group_below_the_limit_is_not_paired(spark, monkeypatch):
    """Copies, each too far from the others but for a chain of four: near enough to share most signatures."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(400), 14):
            copy[at] = f"n{i}x{at}"
        texts.append(copy)
    for _ in range(3):
        step = list(texts[-1])
        step[rng.randrange(400)] = f"c{rng.random()}"
        texts.append(step)
    sets = [{" ".join(w[a:a + 5]) for a in range(len(w) - 4)} for w in texts]
    label = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])) and label[x] != label[y]:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = [new if v == old else v for v in label]
    assert len(set(label)) > 100
    edges = []
    beside = minhash._beside
    monkeypatch.setattr(minhash, "_beside", lambda e, bodies: edges.append(e.count()) or beside(e, bodies))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == dict(enumerate(label))
    assert 0 < sum(edges) < len(texts) * (len(texts) - 1) / 4


def test_rows_without_id_meet_their_own_texts(spark):
    text = lambda i, last: " ".join(f"t{i}w{j}" for j in range(60)) + last
    rows = [(None, text(i, last)) for i in range(20) for last in (" x", " y")] + [(5, text(3, " z"))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.component_id or 0) for r in got) == [0] * 38 + [5] * 3


def test_a_group_of_several_steps_goes_with_few_centres(spark, monkeypatch):
    """Copies of copies share buckets with each step; differences to one of them will do."""
    rng = random.Random(7)

    def edited(words, times, mark):
        copy = list(words)
        for at in rng.sample(range(5, 395, 5), times):
            copy[at] = f"{mark}x{at}"
        return copy

    base = [f"w{i}" for i in range(400)]
    steps = [edited(base, 5, f"s{k}") for k in range(8)]
    texts = [base] + steps + [edited(step, 11, f"c{k}n{i}") for k, step in enumerate(steps) for i in range(20)]
    around = []
    rest = minhash._rest_edges

    def counted(members, *how):
        around.append((members.count(), members.select("cls").distinct().count()))
        return rest(members, *how)

    monkeypatch.setattr(minhash, "_rest_edges", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: 0 if i <= len(steps) else i for i in range(len(texts))}
    [(rows, classes)] = around
    assert len(texts) - 1 - len(steps) <= rows <= 2 * classes   # 802 of 167 classes with a centre per bucket
