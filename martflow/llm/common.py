"""Text and numbering helpers shared by the operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from martflow.session import file_system, fresh_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The runs between separators; null or empty text gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


class Layers:
    """Tables an operator writes to the shared folder and reads back.

    A written layer is computed once, cuts the lineage and survives a lost
    executor.  ``drop`` removes those that no returned frame reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_dir(spark, name), 0

    def write(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        df.write.parquet(path)
        layer = self.spark.read.schema(df.schema).parquet(path)
        layer._layer_path = path
        return layer

    def free_shuffles(self) -> None:
        """Lets Spark remove the shuffle files of layers that are written.

        They go once the driver's JVM has collected the plans that made them,
        which it otherwise does every ``spark.cleaner.periodicGC.interval``.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *layers: DataFrame) -> None:
        for layer in layers:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(layer._layer_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *layers: DataFrame) -> None:
        """Removes all layers but these, and lets their shuffle files go."""
        kept = {layer._layer_path for layer in layers}
        for i in range(self.n):
            if (name := f"{self.root}/{i}") not in kept:
                fs, path = file_system(self.spark, name)
                fs.delete(path, True)
        self.free_shuffles()


def gapless(rows: DataFrame, by: list[str], slot: str, buckets: int = 256) -> DataFrame:
    """Numbers the rows of each ``by`` group from 0 without gaps, adding ``slot``.

    A group may hold most of the table: it is spread over hash buckets, each
    bucket is numbered by itself, and bucket totals (at most ``buckets`` per
    group) give the offsets.  Equal rows are counted first and spread out again
    at the end, so a row repeated without bound does not fill one bucket.
    ``rows`` is read twice; hand in a layer.
    """
    bucket = F.pmod(F.xxhash64(*rows.columns), F.lit(buckets))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    totals = rows.withColumn("_bucket", bucket).groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_by_bucket"),
                            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy(*by, "_bucket").orderBy(*rows.columns)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same = F.col("_bucket") == F.col("_by_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    first = F.col("_first") + F.col("_offset")
    return (placed.join(offsets, same)
            .select(*rows.columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(slot)))


def components(vertices: DataFrame, links: DataFrame, layers: Layers) -> DataFrame:
    """(v, label) with the smallest reachable id as label, for links (a, b).

    Every round lowers a label to the smallest among its neighbours and then to
    the label of that label, so the rounds needed grow with the logarithm of a
    chain's length.  Only vertices that have links take part in the rounds.
    """
    both = layers.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .distinct())
    labels = layers.write(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                          .select("v", F.least("v", "m").alias("label")))
    rounds = 0
    while True:
        rounds += 1
        if rounds % 3 == 0:
            layers.free_shuffles()
        near = (both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near")))
        lower = labels.join(near, labels.v == near.a, "left").select(
            "v", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        to = labels.select(F.col("v").alias("t"), F.col("label").alias("jump"))
        moved = layers.write(lower.join(to, lower.low == to.t, "left")
                             .select("v", "old", F.least("low", "jump").alias("label")))
        done = moved.where("label <> old").isEmpty()
        layers.drop(labels)
        labels = moved
        if done:
            break
    layers.drop(both)
    found = labels.select(F.col("v").alias("_v"), "label")
    return vertices.join(found, vertices.v == F.col("_v"), "left").select(
        "v", F.coalesce("label", "v").alias("label"))
