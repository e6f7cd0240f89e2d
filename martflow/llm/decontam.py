"""Benchmark passages in documents, by a prefix-filtered join of shingles.

A benchmark item gives windows of ten words, and a window gives shingles of five
words.  One pass over the documents keeps the places of shingles that occur in
the benchmark at all; these places give every shingle's frequency in the corpus.
A window can only occur where its rarest shingle does, so only that one prefix
token is joined.  Its position in the window fixes where the window would start;
starts outside the document are dropped.  The rest is verified exactly: every
shingle of the window has to stand at its place.

Nothing is broadcast by hint.  Only functions of Spark are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from martflow.llm.common import Layers, ascii_lower, split_words

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_WORD)


def _shingles(w: Column, n: Column, q: int) -> Column:
    """Hashes of the q-word shingles of ``w``, in order."""
    return F.transform(F.slice(w, 1, F.greatest(n - (q - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(F.lit(q), x, *[F.get(w, i + j) for j in range(1, q)]))


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(window, k, item): distinct windows as text, their words, and an item that has them."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    w = w.withColumn("k", F.least(F.size("w"), F.lit(window))).where("k > 0")
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1))
    return (w.select("item", "k", "w", at.alias("at"))
            .select(F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("window"), "k", "item").distinct())


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items, hits.

    ``hits`` are (start, words) of the verified windows, the widest per start,
    sorted.  Null and empty texts have no words and no hits; items without words
    have no window; an item without an id is named by the empty string; equal
    items are found together.  Repeated rows come out as often as they come in.
    Other columns are not read.  An item of fewer words than ``window`` is one
    window, and of fewer than ``shingle`` one shorter shingle.
    """
    return _found(docs, items, doc_id, text, item_id, item_text, window, shingle,
                  Layers(docs.sparkSession, "decontam")).drop("th")


def _found(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int,
           shingle: int, layers: Layers) -> DataFrame:
    """``contamination`` with the text's hash ``th``, which tells apart texts that share an id."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).select(
        "doc_id", "th", "w", F.size("w").alias("n"))

    named = layers.write(benchmark_windows(items, item_id, item_text, window))
    q = F.least(F.col("k"), F.lit(shingle))
    lengths = sorted(r.q for r in named.select(q.alias("q")).distinct().collect())  # at most ``shingle`` numbers
    plain = named.select("window", "k", q.alias("q")).distinct().withColumn("w", F.split("window", " "))
    parts = [plain.where(F.col("q") == n).select("window", "k", F.posexplode(_shingles(F.col("w"), F.size("w"), n)).alias("j", "h"))
             for n in lengths]
    key = "doc_id", "th", "n"
    if not parts:
        return base.select("doc_id", "th", F.col("n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"),
                           F.array().cast("array<struct<start:int,k:int>>").alias("hits"))
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    tokens = layers.write(tokens)
    wanted = layers.write(tokens.select("h").distinct())

    found = None
    for n in lengths:
        here = base.select(*key, F.posexplode(_shingles(F.col("w"), F.col("n"), n)).alias("pos", "h")).join(wanted, "h")
        found = here if found is None else found.unionByName(here)
    places = layers.write(found.distinct())

    seen = places.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(seen, "h", "left").select("window", "k", "j", "h", F.coalesce("df", F.lit(0)).alias("df"))
    prefix = layers.write(ranked.groupBy("window", "k").agg(F.min(F.struct("df", "j", "h")).alias("p"))
                          .where("p.df > 0").select("window", "k", F.col("p.j").alias("j"), F.col("p.h").alias("h")))
    tried = (places.join(prefix, "h").withColumn("start", F.col("pos") - F.col("j"))
             .where("start >= 0 and start + k <= n").select(*key, "start", "window", "k"))
    need = tried.join(tokens.select("window", "j", "h"), "window").withColumn("pos", F.col("start") + F.col("j"))
    right = places.select(*[F.col(c).alias(f"p_{c}") for c in (*key, "pos", "h")])
    same = F.lit(True)
    for c in (*key, "pos", "h"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    verified = layers.write(
        need.join(right, same, "left_semi").groupBy(*key, "start", "window", "k")
        .agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("at"))
        .where(F.expr(f"at = shiftleft(1L, k - least(k, {shingle}) + 1) - 1"))
        .select(*key, "start", "window", "k"))

    spans = verified.groupBy(*key, "start").agg(F.max("k").alias("k"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("start") + F.col("k") - F.greatest(
        F.col("start"), F.least(F.coalesce(F.max(F.col("start") + F.col("k")).over(before), F.lit(0)),
                                F.col("start") + F.col("k")))
    per_doc = (spans.withColumn("new", new).groupBy(*key)
               .agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "k"))).alias("hits")))
    per_item = (verified.join(named.select("window", "item"), "window").select(*key, "item").distinct()
                .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items")))

    out = base.select(*key)
    for side, cols in ((per_doc, ("n_hit", "hits")), (per_item, ("items",))):
        side = side.select(*[F.col(c).alias(f"s_{c}") for c in key], *cols)
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
        out = out.join(side, same, "left").drop(*[f"s_{c}" for c in key])
    none = F.array().cast("array<string>")
    return out.select("doc_id", "th", F.col("n").cast("long").alias("n_words"),
                      F.coalesce(F.col("n_hit").cast("long"), F.lit(0)).alias("n_hit"),
                      F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                      F.coalesce("items", none).alias("items"),
                      F.coalesce("hits", F.array().cast("array<struct<start:int,k:int>>")).alias("hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, whole, without those in which a benchmark window occurs.

    A row goes by its id and its text together: other texts that share the id, or
    have none like it, stay.
    """
    layers = Layers(docs.sparkSession, "decontam")
    found = _found(docs, items, doc_id, text, item_id, item_text, window, shingle, layers)
    # Written first: its size is then known when the join is planned, and texts are not shuffled for a small one.
    hit = layers.write(found.where("n_hit > 0").select(F.col("doc_id").alias("_hit"), F.col("th").alias("_hit_text")).distinct())
    same = docs[doc_id].eqNullSafe(hit["_hit"]) & (F.xxhash64(docs[text]) == hit["_hit_text"])
    return docs.join(hit, same, "left_anti")
