"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends from the root.  At every node each child draws a number from the
hash of the row's key and the child's name, and the child with the smallest
``-ln(u) / weight`` wins: children win in proportion to their weights, and a
changed weight moves rows only into or out of that child.  A node weighs what its
shards weigh, so a change moves rows only along the branches that lead to it.

A shard that is added with a region of its own takes rows from all others and
moves none between them; one that is added to a rack also draws rows into that
rack, which then spread over all of the rack's shards.

Only the key and the tree decide.  The tree is a literal in the plan; nothing is
joined.  Only functions of Spark are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from martflow.llm.common import Layers, gapless


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 5, start: int = 0) -> list[Shard]:
    """Shards of equal weight in equal racks and regions."""
    per_region = racks_per_region * shards_per_rack
    return [Shard(f"region{s // per_region}", f"rack{s // shards_per_rack}", s) for s in range(start, start + shards)]


def grown(tree: list[Shard]) -> list[Shard]:
    """The tree and one more shard, in a region of its own."""
    new = max(s.shard for s in tree) + 1
    return [*tree, Shard(f"region-{new}", f"rack-{new}", new)]


def _draw(key: Column, children: list[tuple[str, float]]) -> Column:
    """The name of the winning child."""
    scores = []
    for name, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(name).alias("name")))
    return F.array_min(F.array(*scores))["name"] if len(scores) > 1 else F.lit(children[0][0])


def _weights(tree: list[Shard], name) -> list[tuple[str, float]]:
    sums: dict[str, float] = {}
    for s in tree:
        sums[name(s)] = sums.get(name(s), 0.0) + s.weight
    return sorted((n, w) for n, w in sums.items() if w > 0)


def _descent(key: Column, tree: list[Shard]) -> tuple[Column, Column, Column]:
    """Region, rack and shard of a key, each read from the column of the level above.

    A null key has a place like any other.
    """
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    racks, rack_of = F.lit(None).cast("string"), F.lit(None).cast("int")
    for region, _ in _weights(tree, lambda s: s.region):
        inside = [s for s in tree if s.region == region]
        leaves = F.lit(None).cast("int")
        for rack, _ in _weights(inside, lambda s: s.rack):
            shards = [s for s in inside if s.rack == rack]
            won = _draw(key, _weights(shards, lambda s: f"shard{s.shard}"))
            leaves = F.when(F.col("_rack") == rack, F.substring(won, 6, 9).cast("int")).otherwise(leaves)
        racks = F.when(F.col("_region") == region, _draw(key, _weights(inside, lambda s: s.rack))).otherwise(racks)
        rack_of = F.when(F.col("_region") == region, leaves).otherwise(rack_of)
    return _draw(key, _weights(tree, lambda s: s.region)), racks, rack_of


def place(rows: DataFrame, key: Column, tree: list[Shard], shard: str = "shard") -> DataFrame:
    """``rows`` with the column ``shard``; a column of that name is replaced."""
    region, rack, leaf = _descent(key, tree)
    return (rows.drop(shard).withColumn("_region", region).withColumn("_rack", rack)
            .withColumn(shard, leaf).drop("_region", "_rack"))


def sharded(docs: DataFrame, tree: list[Shard], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row.

    ``size`` is the text's UTF-8 bytes plus 16, ``slot`` numbers a shard's rows
    from 0.  A null text counts as empty.  Rows of one id share a shard; equal
    rows get slots of their own.  Other columns are not read.
    """
    layers = Layers(docs.sparkSession, "hash-tree")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    rows = place(rows, F.col("doc_id"), tree)
    rows = place(rows, F.col("doc_id"), grown(tree), "grown_shard")
    return gapless(layers.write(rows), ["shard"], "slot")
