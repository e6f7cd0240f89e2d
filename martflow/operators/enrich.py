"""Dimension lookups: left joins that keep rows without a match.

No join here is hinted.  Catalyst broadcasts a dimension when its size is known
to be under ``spark.sql.autoBroadcastJoinThreshold`` (AQE checks the measured
size again at run time) and otherwise sort-merge joins, where AQE splits a hot
key's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martflow.functions.times import age_in_years


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], take: dict[str, str | Column]) -> DataFrame:
    """Left-join ``dim`` on ``on`` (row column -> dimension column) and set each
    ``take`` column (row column -> dimension column or expression), in place if
    the row has it.  The dimension holds at most one row per key.
    """
    keys = {f"_k{i}": c for i, c in enumerate(on.values())}
    values = {f"_v{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(take.values())}
    side = dim.select(*[F.col(c).alias(n) for n, c in keys.items()],
                      *[c.alias(n) for n, c in values.items()])
    condition = [F.col(left) == F.col(name) for left, name in zip(on, keys)]
    named = {c: F.col(v) for c, v in zip(take, values)}
    return df.join(side, condition, "left").withColumns(named).drop(*keys, *values)


def one_per_key(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Any one row per key, for dimension tables that do not guarantee it."""
    return dim.dropDuplicates(keys)


def add_user(df: DataFrame, users: DataFrame, as_of: Column | None = None) -> DataFrame:
    return lookup(df, users, {"user_id": "id"},
                  {"user_gender": "gender", "user_age": age_in_years("birthday", as_of)})


def add_province(df: DataFrame, provinces: DataFrame) -> DataFrame:
    return lookup(df, provinces, {"province_id": "id"}, {
        "province_name": "name", "province_area_code": "area_code",
        "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"})


def add_sku(df: DataFrame, skus: DataFrame, price: bool = False) -> DataFrame:
    take = {"sku_name": "sku_name", "spu_id": "spu_id", "category3_id": "category3_id", "tm_id": "tm_id"}
    if price:
        take["sku_price"] = "price"
    return lookup(df, skus, {"sku_id": "id"}, take)


def add_spu(df: DataFrame, spus: DataFrame) -> DataFrame:
    return lookup(df, spus, {"spu_id": "id"}, {"spu_name": "spu_name"})


def add_category3(df: DataFrame, categories: DataFrame) -> DataFrame:
    return lookup(df, categories, {"category3_id": "id"}, {"category3_name": "name"})


def add_trademark(df: DataFrame, trademarks: DataFrame) -> DataFrame:
    return lookup(df, trademarks, {"tm_id": "id"}, {"tm_name": "tm_name"})


def add_product(df: DataFrame, dims: dict[str, DataFrame], price: bool = False) -> DataFrame:
    """sku, then the three dimensions its row points to."""
    df = add_sku(df, dims["sku"], price)
    df = add_spu(df, dims["spu"])
    df = add_category3(df, dims["category3"])
    return add_trademark(df, dims["trademark"])


def add_all(df: DataFrame, dims: dict[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """All six dimensions of an order line."""
    return add_product(add_province(add_user(df, dims["user"], as_of), dims["province"]), dims)
