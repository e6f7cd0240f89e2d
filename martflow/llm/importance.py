"""Importance resampling towards a target distribution.

Features are runs of consecutive words, hashed into buckets.  A bucket's gain is the
logarithm of how much more likely the target is to use it than the corpus; a
document's weight is the sum of its features' gains.  Weights are scored through
one array of gains, indexed by bucket.  With a Gumbel draw that the id fixes, the
highest scores are a sample without replacement in proportion to the weights.

The cutoff is selected, not sorted: each block of keys gives its median, the
median of these medians, weighted by the keys their blocks still hold, is the pivot,
and at least a quarter of the keys lie on each side of it.  Keys are counted on one
side, the side without the cutoff is discarded, and so on until the cutoff key is
known exactly.  Only the winners are then sorted, by ranges of keys.

Keys are (score falling, id rising, place in the written layer), so no two are
equal.  The driver sees one row per bucket and one median per block of keys.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from martflow.llm.common import Layers

LONGEST = 1          # words in the longest feature
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20       # shorter documents are scored but not drawn
DRAW, OF = 10, 100   # so many of so many eligible documents are drawn
BLOCK = 1 << 17      # keys that give one median, or are settled in one task

SCORED = "doc_id long, n_features long, n_words long, weight long, score long"
_LAST_ID = 2**63 - 1   # rows without an id come last among equal scores

# Fixed by the definition of a word: digits, letters (lower-cased) and all beyond ASCII.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
                  for c in range(256))


def features(raw: bytes | None, longest: int, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of every feature of a UTF-8 text, and its number of words."""
    words = raw.translate(_TO_WORDS).split() if raw else []
    n = len(words)
    parts = [np.fromiter(map(crc32, words), np.int64, n)]
    for size in range(2, min(longest, n) + 1):
        runs = (b" ".join(words[i:i + size]) for i in range(n - size + 1))
        parts.append(np.fromiter(map(crc32, runs), np.int64, n - size + 1))
    return np.concatenate(parts) % buckets, n


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs; one row per task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                counts += np.bincount(features(raw, longest, buckets)[0], minlength=buckets) if raw else 0
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    rows = (texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target to corpus."""
    k = len(corpus)
    big_s, big_t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + k) / ((s + 1) * (big_t + k))))
                     for s, t in zip(map(float, corpus), map(float, target))], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths, fixed by id and seed (no id: an empty one)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, doc_id: str, text: str, whole: bool) -> DataFrame:
    """The columns ``SCORED`` of each row; with ``whole`` the row itself as ``row``."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                used, n_words = features(raw, longest, buckets)
                weight = int(gain[used].sum())
                out.append((len(used), n_words, weight, weight + noise(key, seed)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]],
                                             ["doc_id", "n_features", "n_words", "weight", "score",
                                              *batch.schema.names[2:]])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    schema = SCORED + (f", row {rows.schema['row'].dataType.simpleString()}" if whole else "")
    return rows.mapInArrow(run, schema)


# --- selection -------------------------------------------------------------------

Key = tuple[int, int, int]   # (-score, id, place): smaller comes first


def _before(key: Key) -> Column:
    score, tie, place = F.lit(-key[0]), F.lit(key[1]), F.lit(key[2])
    return ((F.col("score") > score) | ((F.col("score") == score) & (
        (F.col("tie") < tie) | ((F.col("tie") == tie) & (F.col("place") < place)))))


def _after(key: Key) -> Column:
    return ~_before(key) & ~((F.col("score") == -key[0]) & (F.col("tie") == key[1]) & (F.col("place") == key[2]))


def _nth_of_blocks(block: int, nth: int | None):
    """The median of every block of keys, or the ``nth`` (from 0) of a single block."""

    def pick(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        score, tie, place = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((place, tie, -score))
        at = order[len(order) // 2 if nth is None else nth]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(v)]) for v in (len(order), -score[at], tie[at], place[at])], ["n", "low", "tie", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            held += batch.num_rows
            if held >= block and nth is None:
                yield pick(parts)
                parts, held = [], 0
        if held:
            yield pick(parts)

    return run


def cutoff(keys: DataFrame, draw: int, layers: Layers, block: int = BLOCK) -> Key | None:
    """The ``draw``-th key of ``keys`` (score, tie, place); None if there are fewer or ``draw`` is 0.

    At most ``block`` remaining keys are settled in one task.  A round leaves at most
    three quarters of the keys, about half as a rule; they are written anew whenever
    three quarters of what is written no longer count.
    """
    total = keys.count()
    if not 0 < draw <= total:
        return None
    rest, written, own, wanted = keys, total, None, draw
    pick = "n long, low long, tie long, place long"
    while total > block:
        medians = sorted((r.low, r.tie, r.place, r.n) for r in rest.mapInArrow(_nth_of_blocks(block, None), pick).collect())
        half, seen = sum(m[3] for m in medians) / 2, 0
        for *pivot, n in medians:
            seen += n
            if seen >= half:
                break
        before = rest.where(_before(tuple(pivot))).count()
        if before == wanted - 1:
            return tuple(pivot)
        if before >= wanted:
            rest, total = rest.where(_before(tuple(pivot))), before
        else:
            rest, total, wanted = rest.where(_after(tuple(pivot))), total - before - 1, wanted - before - 1
        if total * 4 < written:
            done, own = own, layers.write(rest)
            rest, written = own, total
            if done is not None:
                layers.drop(done)
    only = rest.repartition(1).mapInArrow(_nth_of_blocks(block, wanted - 1), pick).collect()[0]
    if own is not None:
        layers.drop(own)
    return only.low, only.tie, only.place


def _numbered(winners: DataFrame, layers: Layers) -> DataFrame:
    """``winners`` with ``rank`` from 1: sorted by ranges of keys, then counted range by range."""
    ranges = winners.repartitionByRange(F.desc("score"), "tie", "place").sortWithinPartitions(F.desc("score"), "tie", "place")
    # The upper bits of this number are the range, the lower 33 the place in it.
    spread = layers.write(ranges.withColumn("at", F.monotonically_increasing_id()))
    sizes = spread.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per range
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("at").bitwiseAND(2**33 - 1) + 1
    return (spread.join(offsets, F.shiftright("at", 33) == F.col("part"))
            .withColumn("rank", rank).select(*winners.columns, "rank"))


def _ranked(docs, target, longest, buckets, seed, min_words, draw, of, doc_id, text, block, whole) -> DataFrame:
    layers = Layers(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    rows = scored(docs, gain, longest, seed, doc_id, text, whole)
    rows = layers.write(rows.withColumn("tie", F.coalesce("doc_id", F.lit(_LAST_ID)))
                        .withColumn("place", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= min_words
    keys = rows.where(eligible).select("score", "tie", "place")
    last = cutoff(keys, keys.count() * draw // of, layers, block)
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    drawn = eligible & ~_after(last)
    return (_numbered(rows.where(drawn), layers)
            .unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))))


def ranked(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
           min_words: int = MIN_WORDS, draw: int = DRAW, of: int = OF, doc_id: str = "doc_id", text: str = "text",
           block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score and rank per row of ``docs``, one row each.

    ``rank`` is the place among the drawn rows, from 1, null for the others.  Null and
    empty texts have no feature and weigh 0; rows without an id share one noise and
    come last among equal scores; rows that repeat id and score are ranked in any
    order.  An empty ``target`` has even shares.  Other columns are not read.
    """
    rows = _ranked(docs, target, longest, buckets, seed, min_words, draw, of, doc_id, text, block, False)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
              min_words: int = MIN_WORDS, draw: int = DRAW, of: int = OF, doc_id: str = "doc_id", text: str = "text",
              block: int = BLOCK) -> DataFrame:
    """The drawn rows of ``docs``, whole, with the columns they have."""
    rows = _ranked(docs, target, longest, buckets, seed, min_words, draw, of, doc_id, text, block, True)
    return rows.where(F.col("rank").isNotNull()).select("row.*")
