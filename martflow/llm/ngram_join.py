"""Near duplicates by shingle Jaccard, found through universe partitions.

Sets whose Jaccard similarity is at least ``t`` differ in at most H elements, H
depending on the two sizes.  The hashed universe of shingles is cut into m
segments, m fixed per band of sizes, so at most H segments differ and the others
are equal: two linked sets share the signature of a segment.

*Signatures.*  Every set writes one signature per non-empty segment of its own band
and of the next lower band (sizes of a link are at most 1/t apart, as wide as a
band).  A set with no more than H non-empty segments might share an empty one alone;
two such sets are linked only if they share one of the ``size - ceil(t * size) + 1``
smallest elements of each, so these are written too.  Copies in a task write theirs
once.  Signatures are dealt out by value, and those of a single set go no further.

*Buckets.*  Linked sets have all but H segments of a band in common, so a set that
shares no more than what is above H with any other has no partner in that band
and leaves it.  In what remains a signature is a bucket: its sets are compared
with one centre, and those not linked to it by their differences to one centre of
its component (``minhash.linked``), so that no link is lost and no group is paired
all by all.

Candidates are checked on whole sets.  Elements are 64-bit hashes of
shingles and equal sets are one class, known by a 64-bit hash of elements and
size; both are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from martflow.llm.common import Layers, components
from martflow.llm.minhash import Rule, linked

WORDS = 5
NUM, DEN = 80, 100  # a link needs DEN * intersection >= NUM * union
STARS = 2           # centres of a bucket before differences to the first are compared
CHUNK = 200_000     # signature rows handed over at a time

ROW = "key long, id long, info long, th long"
FOUND = "kind int, a long, b long, size long, spare long, th long"
DOC, OWN, LOWER, ELEMENT = 0, 1, 2, 3

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                         0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(v: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash; wraps around on purpose."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z is lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n >= WORDS:
        v = h[:n - WORDS + 1] * _MULTIPLIERS[0]
        for i in range(1, WORDS):
            v = v + h[i:n - WORDS + 1 + i] * _MULTIPLIERS[i]
    elif n:
        v = (h * _MULTIPLIERS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
    else:
        return h
    return np.unique(_mix(v))


def class_id(v: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(v.tobytes(), seed=len(v)) - (1 << 63)


# --- sizes, bands, budgets -----------------------------------------------------


def differences(a: int, b: int) -> int:
    """The most elements two linked sets of these sizes can differ in."""
    return a + b - 2 * -(-NUM * (a + b) // (NUM + DEN))


def largest_partner(size: int) -> int:
    return size * DEN // NUM


_ENDS = [1]


def band_of(size: int) -> int:
    while _ENDS[-1] < size:
        _ENDS.append(largest_partner(_ENDS[-1] + 1))
    return bisect.bisect_left(_ENDS, size)


@lru_cache(maxsize=None)
def segments_of(band: int) -> int:
    """Segments of a band: what the widest pair needs, and some to spare."""
    end = _ENDS[band]
    most = max(differences(end, s) for s in range(end, largest_partner(end) + 1)[-3:])
    if most == 0:
        return 1
    return most + 1 + -(-(most + 1) * 15 // 100)


@lru_cache(maxsize=None)
def own_budget(size: int) -> int:
    """The most differences to a partner met by the signatures of the set's own band."""
    top = largest_partner(size)
    return max(differences(size, s) for s in range(max(size, top - 2), top + 1))


@lru_cache(maxsize=None)
def lower_budget(size: int) -> int:
    end = _ENDS[band_of(size) - 1]
    return max(differences(s, size) for s in range(max(1, end - 2), end + 1))


# --- signatures ------------------------------------------------------------------


def _cut(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of every element (rising, as ``v`` is sorted) and segment starts."""
    part = ((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part, starts


def exact_keys(v: np.ndarray, band: int) -> np.ndarray:
    part, starts = _cut(v, segments_of(band))
    sums = np.add.reduceat(_mix(v + np.uint64(0x51)), starts)
    return _mix(sums ^ _mix(part[starts] * np.uint64(4096) + np.uint64(band)))


def element_keys(v: np.ndarray) -> np.ndarray:
    """The smallest elements of a set, at least one of which it shares with each partner."""
    return _mix(v[:len(v) + NUM * len(v) // -DEN + 1] + np.uint64(0x53))


def _as_long(v: np.ndarray) -> np.ndarray:
    return v.view(np.int64)


def _info(kind: int, size: int, spare_own: int = 0, spare_lower: int = 0) -> int:
    pack = lambda x: min(max(x, -1), 16382) + 1
    return kind | size << 2 | pack(spare_own) << 34 | pack(spare_lower) << 48


def _rows(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and one per signature of its set; equal sets of a task
    write theirs once."""
    out: list[tuple[np.ndarray, ...]] = []
    held = 0
    known: set[int] = set()

    def flush() -> pa.RecordBatch:
        key, ids, info, th, nameless = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(ids, pa.int64(), mask=nameless), pa.array(info),
             pa.array(th, pa.int64(), mask=info & 3 != DOC)], ["key", "id", "info", "th"])

    def add(keys: np.ndarray, ids: int, info: int, th: int = 0, nameless: bool = False) -> int:
        n = len(keys)
        out.append((keys, np.full(n, ids), np.full(n, info), np.full(n, th), np.full(n, nameless)))
        return n

    for batch in docs:
        for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            v = shingles(text.as_py())
            size, cls = len(v), class_id(v)
            spare_own = spare_lower = 0
            if size:
                band = band_of(size)
                own, lower = exact_keys(v, band), None
                spare_own = len(own) - own_budget(size) - 1
                if band and size <= largest_partner(_ENDS[band - 1]):
                    lower = exact_keys(v, band - 1)
                    spare_lower = len(lower) - lower_budget(size) - 1
                if cls not in known:
                    known.add(cls)
                    held += add(_as_long(own), cls, OWN)
                    if lower is not None:
                        held += add(_as_long(lower), cls, LOWER)
                    if min(spare_own, spare_lower) < 0:
                        held += add(_as_long(element_keys(v)), cls, ELEMENT)
            held += add(np.array([cls]), doc_id or 0, _info(DOC, size, spare_own, spare_lower), th, doc_id is None)
            if held >= CHUNK:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and the signatures of several sets, out of rows sorted by key.

    A signature that goes on in the next batch is handed over as it is: it may be of
    one set, and a set may come again.
    """

    def table(kind, a, b, size, spare, th) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(a), b, pa.array(size), pa.array(spare), th],
            ["kind", "a", "b", "size", "spare", "th"])

    def members(key: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(key), np.int64)
        return table(kind, ids, pa.array(key), zero, zero, pa.nulls(len(key), pa.int64()))

    held = [np.zeros(0, np.int64)] * 3   # the last row, whose key may go on
    met = False                          # whether the row before it has its key
    for batch in batches:
        key, info = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        doc = info & 3 == DOC
        if doc.any():
            at = pa.array(doc)
            more = info[doc]
            yield table(more & 3, key[doc], batch.column(1).filter(at), more >> 2 & 0xFFFFFFFF, more >> 34,
                        batch.column(3).filter(at))
        ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        key, ids, kind = (np.concatenate((h, c[~doc])) for h, c in zip(held, (key, ids, info)))
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        before = np.concatenate(([met], same))
        some = (before[:-1] | same).nonzero()[0]
        held, met = [key[-1:], ids[-1:], kind[-1:]], bool(before[-1])
        edges = key[0], key[-1]
        key, ids, kind = key[some], ids[some], kind[some]
        order = np.lexsort((ids, key))
        key, ids, kind = key[order], ids[order], kind[order]
        fresh = np.ones(len(key), bool)   # copies count once
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids, kind = key[fresh], ids[fresh], kind[fresh]
        several = np.isin(key, edges)
        several[1:] |= key[1:] == key[:-1]
        several[:-1] |= key[1:] == key[:-1]
        if several.any():
            yield members(key[several], ids[several], kind[several])
    if met:
        yield members(*held)


# --- the join --------------------------------------------------------------------


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id per row of ``docs``.

    Null and empty texts have no shingle and are linked with nothing; texts of
    fewer than five words are one shingle.  Rows without an id are linked like
    others but name no component: ``component_id`` is the smallest id that is
    not null, null if there is none.  Repeated rows come out as often as they
    come in.  Other columns are not read.
    """
    docs_of, named = _classes(docs, doc_id, text, Layers(docs.sparkSession, "ngram-join"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component"))
    of_class = named.join(smallest, "label").select("cls", "component")
    return docs_of.join(of_class, "cls", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(docs: DataFrame, doc_id: str, text: str, layers: Layers) -> tuple[DataFrame, DataFrame]:
    """(cls, doc_id, size, ...) per row of ``docs``, and (cls, first_id, label) per class that
    is not empty: classes of one label are linked."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
                        F.col(text).cast("string").alias("text"))
    # A document only passes through: its row goes by itself, not to all copies of its text.
    place = F.when(F.col("info").bitwiseAND(3) == DOC, F.xxhash64("id", "th", "key")).otherwise(F.col("key"))
    found = layers.write(texts.mapInArrow(_rows, ROW).repartition(place).sortWithinPartitions("key")
                         .mapInArrow(_shared, FOUND))
    layers.free_shuffles()
    docs_of = layers.write(found.where(f"kind = {DOC}").select(
        F.col("a").alias("cls"), F.col("b").alias("doc_id"), "th", "size",
        ((F.col("spare").bitwiseAND(16383)) - 1).alias("spare_own"),
        (F.shiftright("spare", 14) - 1).alias("spare_lower")))
    # The first row's id and text hash find one text of the class again.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th"))
    classes = layers.write(docs_of.where("size > 0").groupBy("cls", "size").agg(
        first.alias("first"), F.first("spare_own").alias("spare_own"), F.first("spare_lower").alias("spare_lower")))
    weighed = _buckets(found.where(f"kind <> {DOC}").select(F.col("a").alias("cls"), F.col("b").alias("key"), "kind"),
                       classes, layers)
    layers.drop(found)

    wanted = layers.write(weighed.select(F.col("cls").alias("_c")).distinct().join(classes, F.col("cls") == F.col("_c"))
                          .select("cls", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th")))
    layers.free_shuffles()
    # Not left to the sizes at hand: these two grow together, so the plan is the same at any scale.
    bodies = layers.write(texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
                          .groupBy("cls").agg(F.first("text").alias("text")))
    layers.free_shuffles()
    links = linked(weighed, bodies, layers, STARS, Rule(NUM, DEN, shingles), _open_only, _main_hubs)

    labels = components(classes.select(F.col("cls").alias("v")), links, layers).withColumnRenamed("v", "cls")
    named = layers.write(classes.select("cls", F.col("first.doc_id").alias("first_id")).join(labels, "cls"))
    layers.drop(bodies, weighed, wanted)
    return docs_of, named


def _buckets(members: DataFrame, classes: DataFrame, layers: Layers) -> DataFrame:
    """(key, cls, size, kind, spare, weight) of the ``members`` (key, cls, kind) that may have
    a partner in their bucket; ``weight`` counts the buckets of a set."""
    sizes = classes.select(F.col("cls").alias("_c"), "size", "spare_own", "spare_lower")
    spare = F.when(F.col("kind") == OWN, F.col("spare_own")).when(F.col("kind") == LOWER, F.col("spare_lower")).otherwise(-1)
    # Dealt out by set once: repeats, sizes and both counts need no other shuffle.
    sized = (members.repartition("cls").distinct().join(sizes.hint("merge"), F.col("cls") == F.col("_c"))
             .select("key", "cls", "kind", "size", spare.alias("spare")))
    weight = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    return layers.write(_open_only(sized).withColumn("weight", weight))


def _open_only(members: DataFrame) -> DataFrame:
    """Without the members that share too few buckets: a pair, which both sides would
    still have to meet, shares more than ``spare``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cls", "kind"))
    return members.withColumn("n", n).where("n > spare").drop("n")


def _main_hubs(members: DataFrame) -> DataFrame:
    """The centres of each set's buckets, without the rarest of them.

    Two linked sets share more buckets than either's ``spare``; if each leaves out half
    its ``spare`` at most, there is one that both keep.
    """
    counts = (members.repartition("cls").groupBy("cls", "kind", "size", "label", "spare", "hub", "hub_label")
              .agg(F.count(F.lit(1)).alias("n")))
    upto = Window.partitionBy("cls", "kind").orderBy("n", "hub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (counts.withColumn("upto", F.sum("n").over(upto)).where("upto > greatest(spare, 0) div 2")
            .select("hub", "hub_label", "cls", "size", "label"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class and size of every text, beside id and text hash."""
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([class_id(v) for v in sets], pa.int64()),
             pa.array([len(v) for v in sets], pa.int64())], ["doc_id", "th", "cls", "size"])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, with one row of each group: that of the smallest id,
    ids before none, and then of the smallest text hash.

    A row goes by its id and its text together, so texts that share an id, or have
    none, are told apart.  Of rows that share id and text one stays.  Rows without
    a shingle are in no group.
    """
    layers = Layers(docs.sparkSession, "keep-one")
    _, classes = _classes(docs, doc_id, text, layers)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    names = texts.mapInArrow(_named, "doc_id long, th long, cls long, size long")
    # One row per id and text; combined before the shuffle.
    names = layers.write(names.groupBy("doc_id", "th", "cls", "size").agg(F.count(F.lit(1)).alias("n")))
    grouped = names.where("size > 0").join(classes.select("cls", "label"), "cls")
    first = grouped.groupBy(F.col("label").alias("_label")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    judged = grouped.join(first, F.col("label") == F.col("_label")).select("doc_id", "th", stays.alias("stays"), "n")
    judged = judged.unionByName(names.where("size = 0").select("doc_id", "th", F.lit(True).alias("stays"), "n"))
    # Only rows to drop and repeated ones are joined to; written first, so that their size is known then.
    marks = layers.write(judged.where("not stays or n > 1").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "stays"))
    layers.keep_only(marks)   # the returned frame reads no other
    same = docs[doc_id].cast("long").eqNullSafe(marks["_id"]) & (F.xxhash64(docs[text]) == marks["_th"])
    kept = docs.join(marks, same, "left_anti")
    repeated = marks.where("stays")
    if repeated.isEmpty():
        return kept
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"))
    again = whole.join(repeated, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return kept.unionByName(again.dropDuplicates(["_id", "_th"]).select("row.*"))
