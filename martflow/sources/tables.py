"""Dimension snapshots and statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stats_table(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """A statistics table; ``day`` (``yyyy-MM-dd``) prunes to one ``dt`` folder."""
    rows = spark.read.parquet(path)
    return rows if day is None else rows.filter(F.col("dt") == F.lit(day).cast("date"))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same table kept in a database; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def dim_rows(dim: DataFrame, **keys) -> DataFrame:
    """Rows of a dimension for the given key values (all must match)."""
    for column, value in keys.items():
        dim = dim.filter(F.col(column) == F.lit(value))
    return dim
