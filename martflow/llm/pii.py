"""Personal data by patterns of form and by bootstrapped contexts.

Spans of four kinds are found by their form.  They are the seeds of the method:
the last word in front of a seed, without the marks around it ("phone:", "mailto"), is
a lexical pattern of its kind, and the strings that stand behind a pattern are its
instances.  Candidates are strings of looser form: digit groups without a +, digit
runs that fail the check sum, mail addresses written with (at) and (dot).  A fifth
kind are secrets: keys of a known form are seeds, long runs of letters and digits
candidates, and only a pattern makes either a span, since a bare checksum has the same
form.  Patterns and instances make a
bipartite graph that is scored in rounds: a pattern's confidence is the score of
its instances over *all* occurrences of its word in the corpus, so that common
words count for little; an instance's score is the combined confidence of its
patterns.  In each round words in front of enough distinct strings that have a score,
discovered ones included, become patterns too; rounds go on while any is added or accepted.
Candidates behind patterns of high confidence become spans, unless they
overlap one found by form.

Positions are code points.  Matches and the gaps between them, from the same
expression, give positions and contexts, summed block by block: the work grows with
the text however many matches it holds, and no row leaves the JVM.  The graph holds
distinct (kind, word, string) triples with counts, combined before the shuffle.

Only functions of Spark are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martflow.llm.common import Layers, ascii_lower, split_words

KINDS = ("email", "ip", "card", "phone", "secret")
N_FORMS = 4   # kinds found by form alone, the first ones

# Fixed forms.  Runs are matched possessively and only from where they start, which
# finds the same leftmost matches in linear time.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

# Looser forms, for candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
             r"(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+){2}",
    "card": r"(?<![0-9+.-])[0-9]{4}+(?:[\x20-]?[0-9]{4}+){3}(?![0-9])",
    "phone": r"(?<![0-9+.@-])\(?[0-9]{2,5}+\)?[\x20./-][0-9]{2,5}+(?:[\x20./-]?[0-9]{2,5}+){0,3}(?![0-9@])",
    "secret": r"(?<![A-Za-z0-9_+-])(?=[A-Za-z_+-]*+[0-9])(?=[0-9_+-]*+[A-Za-z])[A-Za-z0-9_+-]{16,}+",
}

# Keys of a known form: hexadecimal digests and some issuers' prefixes.
SECRET_SEED = (r"^(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}"
               r"|sk_(?:live|test)_[A-Za-z0-9]{24,})$")

ROUNDS = 3             # at least; more while patterns are added or accepted
MIN_SEEDS = 5          # distinct scored strings that a pattern must stand in front of
MIN_CONFIDENCE = 0.5
BLOCK = 64             # matches whose positions are summed at a time

SPAN = "struct<kind:int,start:int,end:int>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(1) + (i - 1) % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _fits(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_IP)
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(F.lit(False))


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that spares most texts the pattern."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]{1,}+\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")


_MATCH = "array<struct<start:int,end:int,match:string,word:string>>"
_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
# Between two bare words: marks, white space, and marks again.
_BETWEEN = r"[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]*+[\x20\x09-\x0D][^A-Za-z0-9\x{80}-\x{10FFFF}]*+"


def _context(gap: Column) -> Column:
    """The last word of the text in front of a match, A-Z in lower case, without the
    marks around it; null if there is none close by."""
    before = F.right(gap, F.lit(40))
    word = F.regexp_extract(before, rf"({_WORD}(?:[^\x20\x09-\x0D]*{_WORD})?)[\x00-\x7F&&[^A-Za-z0-9]]*$", 1)
    return F.when(word != "", ascii_lower(word))


def _matches(text: Column, pattern: str, hint: Column) -> Column:
    """(start, end, match, word) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(_MATCH)
    pieces = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("length"), m.alias("match"), _context(g).alias("word")))

    def step(acc, p):
        start = acc["pos"] + p["gap"]
        end = start + p["length"]
        span = F.struct(start.alias("start"), end.alias("end"), p["match"].alias("match"), p["word"].alias("word"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(block):   # positions from the block's own start
        return F.aggregate(block, F.struct(F.lit(0).alias("pos"), none.alias("out")), step)

    def moved(part):
        return F.transform(part["out"], lambda s: F.struct(
            (s["start"] + part["off"]).alias("start"), (s["end"] + part["off"]).alias("end"), s["match"].alias("match"),
            s["word"].alias("word")))

    def spans(pieces):
        blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(pieces) - 1, F.lit(BLOCK)).cast("int")),
                             lambda i: placed(F.slice(pieces, i * BLOCK + 1, F.lit(BLOCK))))
        sums = F.aggregate(
            blocks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<struct<off:int,out:{_MATCH}>>").alias("parts")),
            lambda acc, b: F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["parts"], F.array(F.struct(
                acc["pos"].alias("off"), b["out"].alias("out")))).alias("parts")))
        return F.flatten(F.transform(sums["parts"], moved))

    # Most texts have a few matches at most: one block, without moving it.
    return F.when(hint & text.rlike(pattern), F.when(F.size(found) <= BLOCK, placed(pieces)["out"]).otherwise(spans(pieces))).otherwise(none)


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, th, base spans and candidates, each with its word in front."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hints = {"email": F.contains(F.col("text"), F.lit("at")), "secret": F.col("text").rlike(r"[A-Za-z0-9_+-]{16}")}
    cols = {f"b{i}": _matches(F.col("text"), FORMS[k], _hint(k, F.col("text"))) for i, k in enumerate(KINDS[:N_FORMS])}
    cols |= {f"c{i}": _matches(F.col("text"), LOOSE[k], hints.get(k, F.col("text").rlike("[0-9]{2}"))) for i, k in enumerate(KINDS)}
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), *[c.alias(n) for n, c in cols.items()])

    def tagged(i: int, column: str):
        return F.transform(F.col(column), lambda m: F.struct(
            F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), m["word"].alias("word")))

    base = F.concat(*[tagged(i, f"b{i}") for i in range(N_FORMS)])
    base = F.filter(base, lambda m: F.when(m["kind"] == 0, _fits("email", m["match"]))
                    .when(m["kind"] == 1, _fits("ip", m["match"])).when(m["kind"] == 2, _fits("card", m["match"]))
                    .otherwise(_fits("phone", m["match"])))
    loose = F.concat(*[tagged(i, f"c{i}") for i in range(len(KINDS))])
    out = rows.select("doc_id", "th", base.alias("base"), loose.alias("loose"))
    free = F.filter("loose", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.select("doc_id", "th", "base", free.alias("loose"))


def _occurrences(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """(word, total): how often each of ``words`` stands in all texts, marks around it left out."""
    spaced = F.concat(F.lit(" "), ascii_lower(F.col(text)), F.lit(" "))
    every = docs.select(F.explode(split_words(spaced, _BETWEEN)).alias("word"))
    return every.join(words, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("total"))


def accepted_patterns(marked: DataFrame, docs: DataFrame, text: str, layers: Layers) -> DataFrame:
    """(kind, word, confidence) of the patterns that discover spans."""
    def edges(column: str, seed: Column) -> DataFrame:
        return (marked.select(F.explode(column).alias("m")).where("m.word is not null")
                .groupBy("m.kind", "m.word", "m.match").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("seed", seed))

    # A word seen with fewer distinct strings than MIN_SEEDS never gets enough of them.
    every = layers.write(edges("base", F.lit(True)).unionByName(
        edges("loose", (F.col("kind") == KINDS.index("secret")) & F.col("match").rlike(SECRET_SEED))))
    enough = layers.write(every.groupBy("kind", "word").agg(F.count_distinct("match").alias("strings")).where(
        F.col("strings") >= MIN_SEEDS).select("kind", "word"))
    totals = layers.write(_occurrences(docs, text, enough.select("word").distinct()))
    every = layers.write(every.join(enough, ["kind", "word"]).join(totals, "word"))
    seeds = layers.write(every.where("seed").select("kind", "match", F.lit(1.0).alias("score")).distinct())
    scores, words, patterns, before, rounds = seeds, None, None, None, 0
    while True:
        # Words in front of enough distinct strings that are seeds or were discovered so far.
        reached = every.join(scores.where("score > 0"), ["kind", "match"]).groupBy("kind", "word").agg(
            F.count_distinct("match").alias("strings")).where(F.col("strings") >= MIN_SEEDS).select("kind", "word")
        words = layers.write(reached)
        graph = every.join(words, ["kind", "word"])
        # A word that stands in front of the string without white space ("tel:") is no
        # word of the text by itself: its strings are then all its occurrences.
        mass = (graph.join(scores, ["kind", "match"], "left")
                .groupBy("kind", "word").agg(F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))).alias("mass"),
                                             F.sum("n").alias("behind"), F.first("total").alias("total")))
        patterns = layers.write(mass.select(
            "kind", "word", (F.col("mass") / F.greatest("total", "behind")).alias("confidence")))
        sure = patterns.where(F.col("confidence") >= MIN_CONFIDENCE)
        # Scores never fall, so both numbers only grow and the rounds end.
        now, rounds = (words.count(), sure.count()), rounds + 1
        if now == before and rounds >= ROUNDS:
            return sure
        before = now
        miss = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        found = graph.join(sure, ["kind", "word"]).groupBy("kind", "match").agg((F.lit(1.0) - F.exp(miss)).alias("score"))
        # A seed keeps its score whatever stands in front of it.
        scores = layers.write(found.unionByName(seeds).groupBy("kind", "match").agg(F.max("score").alias("score")))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every row.

    ``base`` are the spans found by form, ``spans`` these and the discovered ones,
    secrets among them, both by kind and start; ends are exclusive.  Null and empty texts have none.
    Among overlapping discovered spans of one kind each candidate form gives only
    non-overlapping ones.  Repeated rows come out as often as they come in; other
    columns are not read.
    """
    layers = Layers(docs.sparkSession, "pii")
    marked = layers.write(_marked(docs, doc_id, text))
    patterns = layers.write(accepted_patterns(marked, docs, text, layers))
    new = (marked.select("doc_id", "th", F.explode("loose").alias("m"))
           .select("doc_id", "th", "m.*").join(patterns.select("kind", "word"), ["kind", "word"])
           .select(F.col("doc_id").alias("n_id"), F.col("th").alias("n_th"), F.struct("kind", "start", "end").alias("s"))
           .groupBy("n_id", "n_th").agg(F.collect_set("s").alias("added")))
    base = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rows = marked.join(new, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("th") == F.col("n_th")), "left")
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), "added")
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(
        "added", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
