"""Near duplicates by one-permutation minhash, stars of candidates and exact checks.

One hash orders the shingles of a document.  The range of the hash is cut into
``BANDS * ROWS`` bins and each keeps its smallest element; an empty bin takes over
the value of the first bin that is not empty in an order of its own (optimal
densification), so two sketches agree in any place with a probability equal to the
Jaccard similarity of their sets, be they small.  ``ROWS`` places make a band, and
sets that share a band lie in one bucket.  At the similarity of the limit a pair
shares no bucket once in 10^8 cases; that is all the method can miss.

Equal sets are one class, known by 128 bits.  Of a bucket of n classes not all pairs
are made but a star: its centre against the others, at most n - 1 edges.  Edges are
checked on whole shingle sets, and the links join classes to components.  A centre
is then done with in its bucket.  If ``STARS`` is above 1, buckets that still hold
several components get a new centre out of the largest.  What remains are
classes that are not linked to the first centre of a bucket; each is held against
the others there by an exact prefix filter over what sets have that a centre of its
component has not, and the other way round (``_rest_edges``), so that no link within a
bucket is lost.

Texts travel to their checks once per edge.  A centre with many edges is copied to
several tasks, each with a share of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from martflow.llm.common import Layers, components

WIDTH = 3             # words in a shingle
NUM, DEN = 85, 100    # a link needs DEN * intersection >= NUM * union
BANDS, ROWS = 32, 5
STARS = 1             # rounds of stars
EDGES = 1_000         # edges of one centre that one task checks
MARK = 0x5DEECE66D1CE4E5B  # keeps single short texts apart from shingles

DIGEST = "doc_id long, th long, hi long, lo long, size int, bands array<long>"


def _mix(v: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash; wraps around on purpose."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


_WEIGHTS = _mix(np.arange(1, 1 + max(WIDTH, ROWS), dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z is lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n == 0:
        return h
    if n < WIDTH:   # the whole text is one shingle
        return _mix((h * _WEIGHTS[:n]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(MARK + n))
    v = np.zeros(n - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        v += h[i:n - WIDTH + 1 + i] * _WEIGHTS[i]
    return np.unique(_mix(v))


@lru_cache(maxsize=None)
def _lenders(bins: int) -> np.ndarray:
    """For each bin, all bins in the order in which it borrows from them."""
    return np.argsort(_mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins), axis=1)


def sketch(v: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The smallest element of every bin of a set that is not empty."""
    part = ((v >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)   # rises with v
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    own = part[first].astype(np.int64)
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[own], full[own] = v[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _lenders(bins)[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return values


def band_keys(v: np.ndarray) -> np.ndarray:
    rows = _mix(sketch(v)).reshape(BANDS, ROWS)
    return _mix((rows * _WEIGHTS[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(MARK)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    known: set[bytes] = set()   # sets of this task: equal ones give their bands once
    for batch in batches:
        hi, lo, size, bands = [], [], [], []
        for text in batch.column(2):
            v = shingles(text.as_py())
            name = xxhash.xxh3_128_digest(v.tobytes(), seed=len(v))
            whole = np.frombuffer(name, np.int64)
            hi.append(whole[0])
            lo.append(whole[1])
            size.append(len(v))
            bands.append(band_keys(v).view(np.int64) if len(v) and name not in known else none)
            known.add(name)
        ends = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        keys = np.concatenate(bands) if bands else none
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
             pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
            ["doc_id", "th", "hi", "lo", "size", "bands"])


# --- exact checks ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """When two texts are linked: ``den`` * intersection >= ``num`` * union of their
    ``sets``, sorted distinct hashes."""

    num: int
    den: int
    sets: Callable[[str | None], np.ndarray]

    def checked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of rows (hub, share, member, text): the hub's own text comes first."""
        own = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, member, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                v = self.sets(text.as_py())
                if member is None:
                    own = v
                    continue
                both = len(np.intersect1d(own, v, assume_unique=True))
                if self.den * both >= self.num * (len(own) + len(v) - both):
                    a.append(hub)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def different(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each member of a hub has and the hub has not, or the other way round."""
        own = np.zeros(0, np.uint64)
        for batch in batches:
            hubs, members, sizes, found = [], [], [], []
            for hub, member, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                v = self.sets(text.as_py())
                if member is None:
                    own = v
                    continue
                hubs.append(hub)
                members.append(member)
                sizes.append(len(own))
                found.append(np.setxor1d(own, v, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hubs, pa.int64()), pa.array(members, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], ["hub", "cls", "hub_size", "d"])

    def allowed(self, x: str, y: str) -> Column:
        """Whether sets of these sizes can be linked at all."""
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num


RULE = Rule(NUM, DEN, shingles)


def _beside(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows (hub, share, member, text) in the order of the first three: a share of a
    hub's members after the hub's own text."""
    shares = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / EDGES).cast("int").alias("shares"))
    # Texts are shuffled at any scale: a plan that broadcasts a small table's edges tells nothing about a large one's.
    body = bodies.select(F.col("cls").alias("_c"), "text").hint("merge")
    hubs = (shares.join(body, F.col("hub") == F.col("_c"))
            .select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
                    F.lit(None).cast("long").alias("member"), "text"))
    members = (edges.join(shares, "hub").join(body, F.col("member") == F.col("_c"))
               .select("hub", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int").alias("share"), "member", "text"))
    return (hubs.unionByName(members).repartition("hub", "share")
            .sortWithinPartitions("hub", "share", F.col("member").asc_nulls_first()))


def _links(edges: DataFrame, bodies: DataFrame, rule: Rule) -> DataFrame:
    """The edges (hub, member) whose shingle sets are similar enough."""
    return _beside(edges, bodies).mapInArrow(rule.checked, "a long, b long")


def _starred(now: DataFrame, rank: Column) -> DataFrame:
    """``now`` with the centre of each bucket: hub, its size, label and weight."""
    first = F.min(F.struct(rank.alias("rank"), "cls", "size", "label", "weight")).over(Window.partitionBy("key"))
    return now.withColumn("c", first).select(
        *now.columns, F.col("c.cls").alias("hub"), F.col("c.size").alias("hub_size"), F.col("c.label").alias("hub_label"),
        F.col("c.weight").alias("hub_weight"))


def _edges(starred: DataFrame, rule: Rule) -> DataFrame:
    """The edges (hub, member) of the stars, each once."""
    apart = (F.col("label") != F.col("hub_label")) & rule.allowed("size", "hub_size")
    edges = (starred.where(apart).groupBy(F.least("hub", "cls").alias("lo"), F.greatest("hub", "cls").alias("hi"))
             .agg(F.min("hub").alias("hub")))
    return edges.select("hub", F.when(F.col("hub") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("member"))


def _rest_edges(members: DataFrame, bodies: DataFrame, layers: Layers, rule: Rule) -> DataFrame:
    """Edges that stars left out, among ``members`` (hub, cls, size, label, odd) of a hub;
    ``odd`` are not in the hub's component.

    Let C be the hub, a and b the differences of A and B to C in elements, and x what
    these have in common.  A and B differ in a + b - 2x elements, and a pair is linked
    if that is at most s * (|A| + |B|), s = (den - num) / (den + num).  So x must reach
    t = (a + b - s * (|A| + |B|)) / 2, which is above 0 unless both are linked to C.
    An odd one linked to C is one more edge and joins C's component; any pair left
    has an odd one that is not.
    Differences to a common hub are small, and mostly an element's own, so a prefix of
    their rarest elements, a - t + 1 long, meets few others where whole sets of near
    copies would all meet.
    """
    edges = members.select("hub", F.col("cls").alias("member"))
    differ = _beside(edges, bodies).mapInArrow(rule.different, "hub long, cls long, hub_size long, d array<long>")
    sets = layers.write(differ.withColumnsRenamed({"hub": "_h", "cls": "_c"}).join(
        members, (F.col("_h") == F.col("hub")) & (F.col("_c") == F.col("cls"))).drop("_h", "_c"))
    n, wide, narrow = F.size("d"), rule.den + rule.num, rule.den - rule.num
    often = sets.select("hub", F.explode("d").alias("e")).groupBy("hub", "e").agg(F.count(F.lit(1)).alias("times"))
    rare = F.sort_array(F.collect_list(F.struct("times", "e")))
    ranked = (sets.select("hub", "cls", "size", "hub_size", "label", "odd", n.alias("n"), F.explode("d").alias("e"))
              .join(often, ["hub", "e"]).groupBy("hub", "cls", "size", "hub_size", "label", "odd", "n").agg(rare.alias("rare")))
    ranked = layers.write(ranked)
    close = n * wide <= (F.col("size") + F.col("hub_size")) * narrow
    own = sets.where(F.col("odd") & close).select("hub", F.col("cls").alias("member"))
    # The least t with any partner: of an odd one by its own distance, of others by the partner's being odd.
    odd_t = F.ceil((F.col("n") * wide - (F.col("size") + F.col("hub_size")) * narrow) / (2 * rule.den))
    any_t = F.ceil((F.col("n") * wide - (F.col("size") - F.col("hub_size")) * narrow) / (2 * wide))
    prefix = lambda t: F.slice("rare", 1, F.greatest(F.col("n") - F.greatest(t, F.lit(1)) + 1, F.lit(0)).cast("int"))
    entries = layers.write(ranked.select("hub", "cls", "size", "label", "odd", "n", F.posexplode(prefix(any_t)).alias("at", "r"))
                           .select("hub", "cls", "size", "label", "odd", "n", "at", F.col("r.e").alias("e")))
    far = F.col("odd") & (F.col("n") * wide > (F.col("size") + F.col("hub_size")) * narrow)
    outer = ranked.where(far).select("hub", "cls", "size", "label", "n", F.posexplode(prefix(odd_t)).alias("at", "r"))
    outer = outer.select("hub", F.col("r.e").alias("e"), *[F.col(c).alias(f"odd_{c}") for c in ("cls", "size", "label", "n", "at")])
    t = F.ceil(((F.col("n") + F.col("odd_n")) * wide - (F.col("size") + F.col("odd_size")) * narrow) / (2 * wide))
    pairs = outer.join(entries, ["hub", "e"]).where(
        (F.col("label") != F.col("odd_label")) & rule.allowed("size", "odd_size")
        & (F.col("at") <= F.col("n") - t) & (F.col("odd_at") <= F.col("odd_n") - t))
    pairs = pairs.select(F.least("cls", "odd_cls").alias("hub"), F.greatest("cls", "odd_cls").alias("member")).distinct()
    return own.unionByName(pairs)


# --- classes, buckets, rounds --------------------------------------------------------


def linked(members: DataFrame, bodies: DataFrame, layers: Layers, stars: int, rule: Rule = RULE,
           open_only: Callable[[DataFrame], DataFrame] | None = None,
           main_hubs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that join all classes linked within a bucket; ``members`` are
    (key, cls, size, weight) of the buckets with several classes.  After each star
    ``open_only`` may take out members, now with a ``label``, that can have no partner
    of another label left; ``main_hubs`` may leave out centres (``hub``) of a class that
    it needs to meet none of its partners."""
    links = tested = members.sparkSession.createDataFrame([], "a long, b long")
    vertices = layers.write(members.select(F.col("cls").alias("v")).distinct())
    now = members.withColumn("label", F.col("cls"))
    for i in range(stars):
        # Dealt out by bucket once; the windows in a bucket need no other shuffle.
        now = now.repartition("key")
        rank = F.struct(-F.col("weight"), F.xxhash64("cls"))   # what copies were made from shares most buckets
        if i:   # out of the largest component of the bucket
            now = now.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "label")))
            rank = F.struct(-F.col("n"), rank)
        starred = layers.write(_starred(now, rank))
        edges = _edges(starred, rule)
        if i:
            known = (F.least("hub", "member") == F.col("a")) & (F.greatest("hub", "member") == F.col("b"))
            edges = edges.join(tested, known, "left_anti")
        edges = layers.write(edges)
        links = layers.write(links.unionByName(_links(edges, bodies, rule)))
        if i + 1 < stars:
            pairs = edges.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"))
            tested = layers.write(tested.unionByName(pairs))
        # A centre has met its whole bucket.  The first one stands for the bucket later on.
        left = starred.where("cls <> hub").drop("label", "n", "hub_size", "hub_label")
        left = left.drop("hub", "hub_weight") if i else left.withColumnsRenamed({"hub": "main", "hub_weight": "main_weight"})
        labels = layers.write(components(vertices, links, layers))
        layers.free_shuffles()
        now = _several(left.join(labels, F.col("cls") == F.col("v")).drop("v"))
        now = layers.write(open_only(now) if open_only else now)
        layers.drop(starred)
        layers.free_shuffles()
        if now.isEmpty():
            return links
    # Centres of one component are near each other, and any set may serve to tell the
    # differences: one centre for all, or a member would go with as many as its group is large.
    centres = now.select("main", "main_weight").distinct().join(
        labels.select(F.col("v").alias("main"), F.col("label").alias("hub_label")), "main")
    of_label = centres.groupBy("hub_label").agg(F.min(F.struct(-F.col("main_weight"), "main")).alias("c"))
    centres = layers.write(centres.join(of_label, "hub_label").select("main", F.col("c.main").alias("hub"), "hub_label"))
    around = now.join(centres, "main")
    if main_hubs:
        around = main_hubs(around)
    odd = F.col("label") != F.col("hub_label")
    rest = layers.write(around.where("cls <> hub").select("hub", "cls", "size", "label", odd.alias("odd")).distinct())
    strange = rest.where("odd").select(F.col("hub").alias("_h")).distinct()
    rest = rest.join(strange, F.col("hub") == F.col("_h"), "left_semi")
    edges = layers.write(_rest_edges(rest, bodies, layers, rule))
    return layers.write(links.unionByName(_links(edges, bodies, rule)))


def _several(members: DataFrame) -> DataFrame:
    """The members of buckets with several labels."""
    bucket = Window.partitionBy("key")
    return (members.withColumns({"least": F.min("label").over(bucket), "most": F.max("label").over(bucket)})
            .where("least <> most").drop("least", "most"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of ``docs``, one row each.

    Null and empty texts have no shingle and are linked with nothing; texts of fewer
    than three words are one shingle.  Rows without an id are linked like others but
    name no component: ``component_id`` is the smallest id that is not null, null if
    there is none.  ``kept`` says that the row names its component; rows that repeat
    that id are all kept, and so are rows of a component without any id.  Other
    columns are not read.
    """
    layers = Layers(docs.sparkSession, "minhash")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
                        F.col(text).cast("string").alias("text"))
    digests = layers.write(texts.mapInArrow(_digests, DIGEST))
    # The first row's id and text hash find one text of the class again.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th"))
    classes = layers.write(
        digests.where("size > 0").groupBy("hi", "lo").agg(first.alias("first"), F.first("size").alias("size"))
        .withColumn("cls", F.monotonically_increasing_id()))
    rows = layers.write(digests.drop("bands", "th"))

    # Half the name will do here: a class taken for another only joins one more bucket.
    entries = digests.select(F.explode("bands").alias("key"), F.col("hi").alias("_hi"))
    shared = layers.write(entries.groupBy("key").agg(F.min("_hi").alias("least"), F.max("_hi").alias("most"))
                          .where("least <> most").select("key"))
    # Not left to the sizes at hand: these two grow together, so the plan is the same at any scale.
    members = layers.write(entries.join(shared.hint("merge"), "key").join(classes, F.col("hi") == F.col("_hi"))
                           .select("key", "cls", "size").distinct())
    layers.drop(digests)
    layers.free_shuffles()
    weights = members.groupBy(F.col("cls").alias("_c")).agg(F.count(F.lit(1)).alias("weight"))
    weighed = layers.write(members.join(weights, F.col("cls") == F.col("_c")).drop("_c"))
    layers.drop(members)
    wanted = layers.write(weighed.select(F.col("cls").alias("_c")).distinct().join(classes, F.col("cls") == F.col("_c"))
                          .select("cls", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th")))
    bodies = layers.write(texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
                          .groupBy("cls").agg(F.first("text").alias("text")))
    layers.free_shuffles()
    links = linked(weighed, bodies, layers, stars)

    ends = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    labels = components(ends, links, layers).withColumnRenamed("v", "_v")
    named = layers.write(classes.join(labels, F.col("cls") == F.col("_v"), "left").select(
        "hi", "lo", F.coalesce("label", "cls").alias("label"), F.col("first.doc_id").alias("first_id")))
    layers.drop(bodies, weighed, shared, wanted)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component"))
    of_class = named.join(smallest, "label").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "component")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (rows.join(of_class, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
            .select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
