"""The operators over whole tables, for the query catalogue, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow.llm import (decision_list, decontam, hash_tree, importance, licenses, line_dedup, minhash, ngram_join,
                          packing, periodic, pii, toxicity, warc)
from martflow.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by host, block by block, and documents by source, line by line."""
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("tbl"), F.col("page_id").alias("row_id"), line_dedup.host_of(F.col("url")).alias("site"),
        line_dedup.blocks_of(F.col("html")).alias("text"))
    documents = table(spark, sf, "documents").select(
        F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), F.col("source").alias("site"), "text")
    return (line_dedup.drop_boilerplate(pages, F.col("site"))
            .unionByName(line_dedup.drop_boilerplate(documents, F.col("site"))))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rules = decision_list.fit(docs, table(spark, sf, "labels"))
    return decision_list.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = hash_tree.sharded(table(spark, sf, "documents"), hash_tree.even_tree(40))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), TOKENIZER)


def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf, "documents"))


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:pii.N_FORMS])],
                        F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"),
                        F.size(F.filter("spans", lambda s: s["kind"] >= pii.N_FORMS)).cast("long").alias("n_secret"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf, "documents"), rewrite=periodic.planted_tail)
    best = periodic.longest("runs")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[c.alias(n) for n, c in {
        "start": -best["start"], "length": best["length"], "period": -best["period"],
        "exponent_milli": F.call_function("div", 1000 * best["length"], -best["period"]),
        "runs_sha256": F.sha2(periodic.runs_text("runs").cast("binary"), 256),
        "collapsed_sha256": F.sha2(F.col("kept").cast("binary"), 256)}.items()])


QUERIES = {q.__name__: q for q in (
    op1_line_dedup, op2_quality_rules, op3_hash_tree, op4_ngram_join, op5_toxicity, op6_warc, op7_packing,
    op8_license_scan, op9_pii, op10_decontamination, op11_importance, op12_minhash, op13_periodic_runs)}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_SPACED = r"[\x20\x09-\x0D]"


def _words_sql(text: str, separator: str) -> str:
    split = f"string_split_regex(coalesce({text}, ''), '{separator}+')"
    return f"list_filter({split}, lambda x: x <> '')"


# A document's distinct shingles, links between them, and what links reach.
_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, {words} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {width} - 1], ' ') FOR i IN range(1, len(w) - {width} + 2)]) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {num} * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id{kept}
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a"""


def _jaccard(width: int, num: int, more: str = "") -> str:
    return _JACCARD.format(words=_words_sql(_LOWER.format("text"), _SPACED), width=width, num=num, kept=more)


def _template_rows() -> str:
    rows = []
    for name, text in licenses.TEMPLATES.items():
        grams = ", ".join(f"'{g}'" for g in licenses.bigrams_of(text))
        rows.append(f"('{name}', [{grams}])")
    return ", ".join(rows)


ORACLE: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH src AS (
  SELECT 'documents' AS tbl, doc_id AS row_id, source AS site, text FROM documents
  UNION ALL
  SELECT 'pages', page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), ''),
         regexp_replace(regexp_replace(html, '<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', chr(10), 'gis'),
                        '<[^>]*>', chr(10), 'gs') FROM pages),
lines AS (
  SELECT tbl, row_id, site, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i FROM src),
bare AS (
  SELECT *, nullif(regexp_replace(line, '^{_SPACED}+|{_SPACED}+$', '', 'g'), '') AS k FROM lines),
n AS (SELECT tbl, site, k, count(DISTINCT row_id) AS n FROM bare WHERE k IS NOT NULL GROUP BY ALL),
t AS (SELECT tbl, site, count(*) AS pages FROM src GROUP BY ALL),
often AS (SELECT n.tbl, n.site, k FROM n JOIN t ON n.tbl = t.tbl AND n.site IS NOT DISTINCT FROM t.site
          WHERE n >= {line_dedup.MIN_PAGES} AND n > pages * CAST({line_dedup.RATIO} AS DOUBLE)),
marked AS (SELECT b.*, o.k IS NOT NULL AS gone FROM bare b LEFT JOIN often o
           ON b.tbl = o.tbl AND b.site IS NOT DISTINCT FROM o.site AND b.k = o.k)
SELECT tbl, row_id, site, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped
FROM marked GROUP BY tbl, row_id, site""",
    "op4_ngram_join": _jaccard(5, 80),
    "op12_minhash": _jaccard(minhash.WIDTH, minhash.NUM, ", s.doc_id = c.component_id AS kept"),
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS f FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS bits
      FROM d)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((bits[CAST(i // 4 + 1 AS BIGINT)] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to, true AS verified
FROM g""",
    "op8_license_scan": rf"""
WITH t(template, g) AS (VALUES {_template_rows()}),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'line' AS unit, unnest(range(len(lines))) AS line_no, unnest(lines) AS u FROM l
      UNION ALL SELECT doc_id, 'text', -1, text FROM l WHERE len(lines) > 1),
w AS (SELECT doc_id, unit, line_no, {_words_sql(_LOWER.format('u'), '[^a-z0-9]')} AS w FROM u),
b AS (SELECT doc_id, unit, line_no, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b
      FROM w WHERE len(w) > 1),
m AS (SELECT *, len(list_intersect(b, g)) AS c FROM b JOIN t
      ON len(b) * 1.5 >= len(g) AND len(b) <= 1.5 * len(g))
SELECT doc_id, unit, CAST(line_no AS INTEGER) AS line_no, template, CAST(c AS BIGINT) AS n_common,
       CAST(len(b) AS BIGINT) AS n_unit, CAST(2 * c AS DOUBLE) / (len(b) + len(g)) AS dice
FROM m WHERE CAST(2 * c AS DOUBLE) / (len(b) + len(g)) >= {licenses.THRESHOLD}""",
    "op10_decontamination": rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words_sql(_LOWER.format('text'), _CLASS)} AS w FROM benchmark),
k AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS win FROM k),
ks AS (SELECT DISTINCT k FROM win),
d AS (SELECT doc_id, {_words_sql(_LOWER.format('text'), _CLASS)} AS w FROM documents),
occ AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s,
              unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS win FROM d, ks),
hit AS (SELECT DISTINCT doc_id, s, a.k, item FROM occ a JOIN win USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    # DuckDB has no CRC-32: the table of its 256 steps is made from the polynomial.
    "op11_importance": rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
src AS (SELECT 'd' AS side, doc_id, {_words_sql(_LOWER.format('text'), _CLASS)} AS w FROM documents
        UNION ALL SELECT 'b', NULL, {_words_sql(_LOWER.format('text'), _CLASS)} FROM benchmark),
e AS (SELECT side, doc_id, unnest(w) AS word FROM src),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM e)),
b AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(h), 2),
        lambda i: CAST('0x' || substr(h, CAST(i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, x: xor(c >> 8, steps[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % {importance.BUCKETS} AS bucket
      FROM v, crc),
n AS (SELECT bucket, CAST(count(*) FILTER (WHERE side = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE side = 'b') AS DOUBLE) AS t
      FROM e JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {importance.BUCKETS})
        / ((s + 1) * (sum(t) OVER () + {importance.BUCKETS})))) AS BIGINT) AS gain FROM n),
f AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN b USING (word) JOIN g USING (bucket)
      WHERE side = 'd' GROUP BY doc_id),
scores AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(
        -1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM src LEFT JOIN f USING (doc_id) WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {importance.DRAW} * count(*) // {importance.OF} FROM r)
    THEN rank END AS rank FROM scores LEFT JOIN r USING (doc_id)""",
}
