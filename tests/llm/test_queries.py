"""Registered queries against SQL, and against brute force where SQL cannot say it."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martflow.llm import decision_list, hash_tree, ngram_join, packing, queries, toxicity, warc
from oracle_compare import compare, connect

SMALL = "/root/testdata/sf0.001"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE[name]) > 0


def test_quality_counts(spark, texts):
    for r in queries.op2_quality_rules(spark, SMALL).collect():
        text = texts[r.doc_id]
        words = SPACE_WORD.findall(text)
        windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), failed)
        assert not (r.base_failed and r.kept)


def test_quality_rules_keep_good_and_reject_bad(spark, sf_dir):
    judged = queries.op2_quality_rules(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in judged.join(labels, "doc_id").where("not base_failed or quality = 0")
         .groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * n[0, False] and n.get((1, False), 0) <= 0.02 * n[1, True]


def test_shards(spark, texts):
    rows = queries.op3_hash_tree(spark, SMALL).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_confine_movement(spark):
    tree = hash_tree.even_tree(8, 2, 2)
    heavier = [s if s.shard else hash_tree.Shard(s.region, s.rack, s.shard, 3.0) for s in tree]
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    both = hash_tree.place(hash_tree.place(rows, F.col("doc_id"), tree, "a"), F.col("doc_id"), heavier, "b")
    inside = {s.shard for s in tree if s.region == tree[0].region}
    moved = both.where("a <> b").groupBy("a", "b").count().collect()
    assert moved and all(r.b in inside for r in moved)
    share = both.where("b = 0").count() / 4000
    assert abs(share - 0.3) < 0.03


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1) & ((got.score >= 0.3) == (got.predicted == 1))).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    out = got[got.held_out]
    right = out[out.toxic == 1].predicted.mean(), out[out.toxic == 0].predicted.mean()
    assert right[0] > 0.75 and right[1] < 0.05


def test_nnpu_learns_a_word():
    rng = np.random.default_rng(1)
    noise = [np.unique(rng.integers(100, 5000, 40)).astype(np.int32) for _ in range(600)]
    bad = np.arange(600) % 10 == 0
    rows = [np.unique(np.append(r, [7, 9])).astype(np.int32) if b else r for r, b in zip(noise, bad)]
    known = [r for r, b in zip(rows, bad) if b][:30]
    model = toxicity.fit_nnpu(known + rows, np.arange(630) < 30, 0.1)
    score = np.array([model.score(r) for r in rows])
    assert score[bad].min() > 0.3 > score[~bad].max()


def test_archive_rebuilds_records(spark, tmp_path):
    rows = [(3, "http://a/1", "x"), (1, "http://a/2", "x"), (2, "http://a/3\r\nX: y", ""), (4, None, None),
            (1, "http://a/2", "x"), (None, "http://b", "x"), (5, "u", "zé")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    read = warc.read_archive(spark, path)
    records = read.withColumn("raw", warc.record_bytes(read)).collect()
    assert len(records) == len(rows) and all(r.verified for r in records)
    kinds = collections.Counter()
    for r in records:
        head = bytes(r.header).decode()
        kind = re.search("WARC-Type: (.*)\r", head)[1]
        kinds[kind, bytes(r.payload)] += 1
        assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        assert bytes(r.raw) == head.encode() + (bytes(r.payload) if kind == "response" else b"") + b"\r\n\r\n"
        length = int(re.search("Content-Length: (.*)\r", head)[1])
        assert length == (len(r.payload) if kind == "response" else 0) and "\nX: y" not in head
    assert kinds == {("response", b"x"): 1, ("revisit", b"x"): 3, ("response", b""): 1, ("revisit", b""): 1,
                     ("response", "zé".encode()): 1}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    ids = {k: np.append(np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4"), [1]).astype("<u4")
           for k, t in texts.items()}
    rows = queries.op7_packing(spark, SMALL).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for groups, total in ((pieces, {k: len(v) for k, v in ids.items()}), (sequences, {})):
        for k, parts in groups.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == total.get(k, at) and (total or at <= packing.SIZE)
    assert set(pieces) == set(ids) and len(sequences) * packing.SIZE < 1.05 * sum(map(len, ids.values()))


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 300, 80), rng.integers(1, 50, 80))}
    patterns = packing.pack_histogram(histogram, 300)
    placed = collections.Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 300
        for length in lengths:
            placed[length] += count
    assert placed == histogram
    assert packing.pack_histogram({}, 300) == []


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(queries.TOKENIZER)
    texts = ["Don't STOP, it's 42.5%... a.b, (x).", "\x1ce\u0301 ΣΑΣ <|endoftext|> a b", "", "\u3000 \x85",
             "word. word, WORD", "x" * 300 + " y", "İstanbul ẞ ﬁ Å", "Été***\tété&&& l'ann\u00e9e ŉ ǅ's <|endoftext|>"]
    alphabet = "aAéÉİıŉǅµº.,*'\"<|>9 \n\t\u0301\u00a0\u1680\u2028ß\x1fσΣ字"
    random.seed(7)
    texts += ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(500)]
    for column in [*([t] for t in texts), texts]:
        for _ in range(2):  # new words, then known ones
            assert [ids.tobytes() for ids in encoder.encode(pa.array(column, pa.string()))] == encoder.plain(column)
    for size in (1, 7, 1 << 20):
        runs = list(packing.chunks(pa.array(texts), size))
        assert [t for _, run in runs for t in run.to_pylist()] == texts
        assert all(run[0].as_py() == texts[at] for at, run in runs)
    assert list(packing.chunks(pa.array([], pa.string()))) == []


def test_encoder_takes_words_of_letters_to_the_model():
    encoder = packing.Encoder(queries.TOKENIZER)
    letters = [chr(c) for c in range(0x41, 0x250) if packing.LETTERS.fullmatch(chr(c))]
    words = [a + b + "en" for a in letters for b in "a\u00e9z"] + ["Stra\u00dfe", "a" * 99, "\u0178\u00c6\u0132"]
    want = dict(zip(words, encoder.plain(words)))
    encoder.plain = lambda texts: [b""] * len(texts)  # neither normaliser nor patterns from here on
    assert encoder._learn(words) == want
    assert [encoder._stem(w.lower()) for w in words] == [*want.values()]


def test_pii(spark, texts):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    for r in queries.op9_pii(spark, SMALL).collect():
        spans, counts = [], []
        for kind, form in forms.items():
            own = []
            for m in re.finditer(form, texts[r.doc_id]):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind == "ip" and max(map(int, m[0].split("."))) > 255
                        or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                        or kind == "phone" and not 8 <= len(digits) <= 15):
                    continue
                own.append(f"{kind}:{m.start()}:{m.end()}")
            counts.append(len(own))
            spans += own
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}


def _components(sets):
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and sets[x]:
                low, high = sorted((label[x], label[y]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_join_of_many_near_copies(spark):
    """Groups larger than FEW, copies of copies, common passages, tiny and short texts."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    docs, passage = {}, word(60)
    for g in range(3):
        base = word(120)
        for _ in range(40):
            copy = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                copy[at] = f"n{rng.integers(0, 10 ** 9)}"
            docs[len(docs)] = copy
    for _ in range(60):
        docs[len(docs)] = word(int(rng.integers(5, 60))) + passage
    small = word(9)
    for _ in range(80):
        docs[len(docs)] = small[:rng.integers(1, 10)] + word(int(rng.integers(0, 3)))
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: {" ".join(w[a:a + 5]) for a in range(max(1, len(w) - 4))} for i, w in docs.items()}
    want = _components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_pipeline_against_brute_force(spark, texts):
    from martflow.llm import decontam, line_dedup

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = decision_list.fit(docs, labels)
    kept = {r.doc_id for r in decision_list.judged(docs, rules).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    on = collections.Counter()
    pages = collections.Counter(r.source for r in rows.values())
    strip = " \t\n\r\x0b\x0c"
    for r in rows.values():
        on.update({(r.source, x.strip(strip)) for x in r.text.split("\n") if x.strip(strip)})
    gone = lambda s, x: on[s, x] >= line_dedup.MIN_PAGES and on[s, x] > line_dedup.RATIO * pages[s]
    clean = {i: "\n".join(x for x in r.text.split("\n") if not gone(r.source, x.strip(strip))) for i, r in rows.items()}
    words = {i: SPACE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in clean.items()}
    sets = {i: {" ".join(w[a:a + 5]) for a in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    first = {i for i, c in _components(sets).items() if i == c}
    item = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = item(r.text)
        windows |= {tuple(w[a:a + 10]) for a in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = {i for i in first for n in sizes for w in [item(clean[i])] if any(tuple(w[a:a + n]) in windows
                                                                          for a in range(len(w) - n + 1))}
    got = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()}
    assert got == first - hit
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert decontam.contamination(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).where(
        "n_hit > 0").isEmpty()
