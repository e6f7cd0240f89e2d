"""Quality rules: decision lists learned by sequential covering.

Texts are described by a few counts.  From labelled texts, rules for the class to
reject are learned one after another: a rule grows by the threshold condition of
the highest information gain, on two thirds of the labelled rows; it is pruned on
the last third, where trailing conditions go as long as (right - wrong) / covered
does not fall; rows it covers are taken out and the next rule is learned.  The
list ends when a rule is not right on enough of the rows it covers.  It becomes
an ordered conditional expression of Spark over the counts.

The driver fits on counts of at most ``max_labelled`` labelled rows, those of the
smallest id hash: a documented bound.  Counting and judging run over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

MAX_LABELLED = 8_000
MIN_PRECISION = 0.9
MIN_COVER = 4
MAX_CONDITIONS = 4
MAX_RULES = 24

WINDOW = 5
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct",
          "n_top", "n_lines")
COUNT_TYPE = StructType([StructField(c, LongType()) for c in COUNTS])


def _repeated(words: list[bytes], ids: np.ndarray) -> int:
    """Words that lie in a window which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    exact: dict[tuple[int, ...], int] = {}
    keys = [tuple(ids[i:i + WINDOW].tolist()) for i in starts]
    for k in keys:
        exact[k] = exact.get(k, 0) + 1
    covered = np.zeros(len(words), bool)
    for i, k in zip(starts.tolist(), keys):
        if exact[k] > 1:
            covered[i:i + WINDOW] = True
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of a text in the order of COUNTS; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    top = int(np.bincount(ids.astype(np.int64)).max()) if words else 0
    bare = raw.translate(None, _SPACE)
    return (len(words), len(text or "") - (len(raw) - len(bare)), len(raw) - len(raw.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(words, ids),
            len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
            len(raw) - len(raw.translate(None, b"!?.,;:'\"()-")), len(seen), top, len(lines))


@pandas_udf(COUNT_TYPE)
def count_text(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([counts_of(t) for t in s], columns=list(COUNTS), dtype="int64")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What rules may test, by name: an expression over the counts.
MEASURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _ratio("n_repeat_words", "n_words"),
    "upper_share": lambda: _ratio("n_upper", "word_chars"),
    "marks_per_word": lambda: _ratio("n_marks", "n_words"),
    "distinct_share": lambda: _ratio("n_distinct", "n_words"),
    "top_share": lambda: _ratio("n_top", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.measure]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = MEASURES[self.measure]()
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    at = np.ones(n, bool)
    for c in rule:
        at &= c.holds(table)
    return at


def _best(table: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray) -> Condition | None:
    """The condition of the highest gain within the rows ``at``."""
    p0, n0 = (bad & at).sum(), (~bad & at).sum()
    if not n0 or not p0:
        return None
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for name, x in table.items():
        order = np.argsort(x[at], kind="stable")
        v, y = x[at][order], bad[at][order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        p_low = np.cumsum(y)[edge]
        n_low = edge + 1 - p_low
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p >= MIN_COVER, p * (np.log2(p / (p + n)) - base), -1.0)
            i = int(np.argmax(g))
            if g[i] > gain:
                gain = float(g[i])
                best = Condition(name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for the rows ``bad``; none without both classes."""
    rules: list[Rule] = []
    n = len(bad)
    grow = np.arange(n) % 3 < 2
    left = np.ones(n, bool)
    while len(rules) < MAX_RULES:
        at, rule = left & grow, []
        while len(rule) < MAX_CONDITIONS and (c := _best(table, bad, at)):
            rule.append(c)
            at = at & c.holds(table)
        prune = left & ~grow

        def worth(r: list[Condition]) -> float:
            hit = _covers(tuple(r), table, n) & prune
            p, q = (bad & hit).sum(), (~bad & hit).sum()
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = _covers(tuple(rule), table, n) & left
        right = int((bad & hit).sum())
        if not rule or right < MIN_COVER or right < MIN_PRECISION * hit.sum():
            break
        rules.append(tuple(rule))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False where the first rule that holds rejects, true where none holds."""
    out: Column | None = None
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns rules from ``labels`` (doc_id, quality: 1 keep, 0 reject).

    The sample's ids are broadcast: at most ``max_labelled`` longs.  Labels that
    are null, or not 0 or 1, and labels without an id or a text are left out.
    """
    marked = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
              .where("_id is not null and quality in (0, 1)").groupBy("_id").agg(F.min("quality").alias("quality")))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    rows = (texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
            .select("_id", "quality", count_text(F.col("_text")).alias("c")).select("_id", "quality", "c.*")
            .select("_id", "quality", *[m().alias(n) for n, m in MEASURES.items()]).toPandas())
    rows["h"] = [xxhash.xxh3_64_intdigest(str(i).encode()) for i in rows["_id"]]
    rows = rows.sort_values(["h", *MEASURES]).reset_index(drop=True)
    return learn({n: rows[n].to_numpy(float) for n in MEASURES}, rows["quality"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    A null or empty text has no words and fails the base rule.  Repeated rows are
    judged each.  Other columns are not read.
    """
    counted = docs.select(F.col(doc_id).alias("doc_id"), count_text(F.col(text)).alias("c")).select("doc_id", "c.*")
    return counted.withColumn("base_failed", base_failed()).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that the base rule and the list keep."""
    counted = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)],
                          count_text(F.col(text)).alias("_c"))
    counted = counted.select(*[c for c in counted.columns if c != "_c"], "_c.*")
    good = counted.where(~base_failed()).where(verdict(rules))
    return good.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])
