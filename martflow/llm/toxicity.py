"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P; all other training texts, whatever
their label, are unlabelled U.  With the class prior p the risk of a classifier
f is ``p R_P(+) + max(0, R_U(-) - p R_P(-))``: the unlabelled risk is corrected for
the toxic texts hidden in it, and the correction is kept from going negative,
which would reward overfitting.  f is logistic over the presence of hashed words,
fitted with numpy by Adam on the driver; the prior is the share of toxic labels
among the labelled training rows.

Fitting takes at most ``max_positive`` and ``max_unlabelled`` texts, those of the
smallest id hash: a documented bound.  Scoring covers all texts, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

MAX_POSITIVE = 2_000
MAX_UNLABELLED = 6_000
BITS = 20
MAX_FEATURES = 2_000
MIN_Z = 4.0  # standard deviations between the rates in P and in U
THRESHOLD = 0.3

#: Letters, digits and all non-ASCII bytes stay, A-Z in lower case; the rest separates.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def buckets(text: str | None) -> np.ndarray:
    """The sorted distinct hash buckets of a text's words."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(h & np.uint64((1 << BITS) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted buckets
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.features, found)
        at[at == len(self.features)] = 0
        x = self.bias
        if len(self.features):
            x += float(self.weights[at[self.features[at] == found]].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.05,
             decay: float = 2.0) -> Model:
    """Fits the classifier; without positives or unlabelled rows it scores the prior."""
    prior = float(np.clip(prior, 1e-3, 0.999))
    flat_bias = float(np.log(prior / (1 - prior)))
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return Model(np.empty(0, np.int32), np.empty(0), flat_bias)
    size = 1 << BITS
    df_p = np.bincount(np.concatenate([r for r, y in zip(rows, positive) if y]), minlength=size)
    df_u = np.bincount(np.concatenate([r for r, y in zip(rows, positive) if not y]), minlength=size)
    # The words whose rate differs most between P and U, in standard deviations.
    pooled = (df_p + df_u + 1) / (n_p + n_u + 2)
    z = np.abs(df_p / n_p - df_u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    z[(df_p + df_u) < 5] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES]).astype(np.int32)
    chosen = chosen[z[chosen] > MIN_Z]
    own = [np.flatnonzero(np.isin(chosen, r, assume_unique=True)) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in own])
    col = np.concatenate(own) if len(row) else np.empty(0, np.int64)

    w = np.zeros(len(chosen) + 1)
    w[-1] = flat_bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        x = np.bincount(row, w[col], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        loss_minus = np.logaddexp(0, x)
        negative = loss_minus[~positive].mean() - prior * loss_minus[positive].mean()
        # d/dx of log(1 + exp(-x)) is s - 1, of log(1 + exp(x)) it is s.
        g = np.where(positive, prior * (s - 1) / n_p, 0.0)
        correction = np.where(positive, -prior * s / n_p, s / n_u)
        g = g + correction if negative >= 0 else -correction
        grad = np.append(np.bincount(col, g[row], len(chosen)) + decay * w[:-1] / len(rows), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(chosen, w[:-1], float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@pandas_udf(ArrayType(IntegerType()))
def _bucket_column(texts: pd.Series) -> pd.Series:
    return pd.Series([buckets(t) for t in texts])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learns from rows outside the held-out fold; ``labels`` has (doc_id, toxic).

    The sample's ids are broadcast: at most ``max_positive + max_unlabelled``
    longs.  Null labels are no labels; labels and texts without an id are left out.
    """
    marked = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
              .where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).where("_y in (0, 1)")
              .groupBy("_id").agg(F.max("_y").alias("_y")))
    share = marked.agg(F.avg("_y").alias("p")).first()["p"] or 0.0
    every = docs.select(F.col(doc_id).cast("long").alias("_id")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    # U is a draw from all texts, so it hides toxic ones at the rate of the prior.
    known = marked.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(max_positive)
    drawn = every.orderBy(F.xxhash64("_id", F.lit("unlabelled")), "_id").limit(max_unlabelled)
    sample = known.select("_id", F.lit(True).alias("positive")).unionByName(
        drawn.distinct().select("_id", F.lit(False).alias("positive")))
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    rows = (texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
            .select("_id", "positive", _bucket_column(F.col("_text")).alias("b")).toPandas())
    rows = rows.assign(n=[len(b) for b in rows["b"]]).sort_values(["_id", "positive", "n"])
    return fit_nnpu([np.asarray(b, np.int32) for b in rows["b"]], rows["positive"].to_numpy(bool), share)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    The score reads the text alone; null and empty texts get that of a text
    without known words.  Repeated rows are scored each; other columns are not read.
    """
    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([model.score(buckets(t)) for t in s], dtype="float64")

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                       score(F.col(text)).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
