"""Widening order lines and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from martflow import schemas, settings
from martflow.functions.times import time_column
from martflow.operators.intervals import interval_join
from martflow.operators.repeats import each_once


def with_create_parts(orders: DataFrame) -> DataFrame:
    """``create_date``, ``create_hour`` and epoch-millisecond ``create_ts``."""
    t = time_column(orders, "create_time")
    return (orders.withColumn("create_date", F.to_date(t).cast("string"))
            .withColumn("create_hour", F.date_format(t, "HH"))
            .withColumn("create_ts", F.unix_millis(t)))


# order_wide columns the join leaves null: operators.enrich fills the dimension
# columns, and no input ever carries the other two.
_UNSET = {
    "province_name": "string", "province_area_code": "string", "province_iso_code": "string",
    "province_3166_2_code": "string", "user_age": "int", "user_gender": "string", "spu_id": "bigint",
    "tm_id": "bigint", "category3_id": "bigint", "spu_name": "string", "tm_name": "string",
    "category3_name": "string", "expire_time": "string", "split_feight_fee": "decimal(16,2)",
}


# What ``order_lines`` reads of a head and of a line.
HEAD_COLUMNS = ("id", "province_id", "order_status", "user_id", "total_amount", "activity_reduce_amount",
                "coupon_reduce_amount", "original_total_amount", "feight_fee", "create_time", "operate_time")
LINE_COLUMNS = ("id", "order_id", "sku_id", "order_price", "sku_num", "sku_name", "split_activity_amount",
                "split_coupon_amount", "split_total_amount", "create_time")


def order_lines(order_info: DataFrame, order_detail: DataFrame,
                before_s: float = settings.ORDER_JOIN_BEFORE_S,
                after_s: float = settings.ORDER_JOIN_AFTER_S,
                watermark: str | None = None, replayed: bool = False) -> DataFrame:
    """Join heads and lines into order_wide rows, dimension columns still null.

    ``order_ts`` (head time) and ``detail_ts`` come on top of the order_wide
    columns.  Times and money of the head repeat on each line.  ``replayed`` inputs
    may deliver a record again: each counts once.
    """
    t = time_column(order_info, "create_time")
    heads = order_info.select(
        F.col("id").alias("head_id"), *HEAD_COLUMNS[1:], F.to_date(t).cast("string").alias("create_date"),
        F.date_format(t, "HH").alias("create_hour"), t.alias("order_ts"))
    lines = order_detail.select(
        F.col("id").alias("detail_id"), *LINE_COLUMNS[1:-1],
        time_column(order_detail, "create_time").alias("detail_ts"))
    if replayed:
        heads = each_once(heads, "order_ts", ["head_id"], watermark)
        lines = each_once(lines, "detail_ts", ["detail_id"], watermark)
    elif watermark:
        heads, lines = heads.withWatermark("order_ts", watermark), lines.withWatermark("detail_ts", watermark)
    joined = interval_join(heads, lines, ("head_id", "order_id"), ("order_ts", "detail_ts"), before_s, after_s,
                           sliced=False)
    return joined.selectExpr(
        *[f"CAST(NULL AS {_UNSET[c]}) AS {c}" if c in _UNSET else c
          for c in schemas.column_names(schemas.ORDER_WIDE)], "order_ts", "detail_ts")


def payment_wide(payments: DataFrame, order_wide: DataFrame,
                 before_s: float = settings.PAYMENT_JOIN_BEFORE_S,
                 after_s: float = settings.PAYMENT_JOIN_AFTER_S,
                 watermark: str | None = None, replayed: bool = False) -> DataFrame:
    """Payments with the lines of their order, created within ``before_s`` before
    the callback.  Where both sides name a column the payment's value wins.
    ``callback_ts`` and ``order_ts`` come on top of the payment_wide columns.
    ``replayed`` inputs may deliver a record again: each counts once.  An
    ``order_wide`` that still has its ``order_ts``, with a watermark if it is a
    stream, is joined by it.
    """
    pay = payments.select(
        F.col("id").alias("payment_id"), F.col("order_id").alias("pay_order_id"),
        F.col("user_id").alias("pay_user_id"), F.col("total_amount").alias("pay_total_amount"),
        "subject", "payment_type", F.col("create_time").alias("payment_create_time"), "callback_time",
        time_column(payments, "callback_time").alias("callback_ts"))
    chained = "order_ts" in order_wide.columns
    wide = order_wide if chained else order_wide.withColumn("order_ts", time_column(order_wide, "create_time"))
    if replayed:
        pay = each_once(pay, "callback_ts", ["payment_id"], watermark)
        wide = wide if chained else each_once(wide, "order_ts", ["detail_id"], watermark)
    elif watermark:
        pay = pay.withWatermark("callback_ts", watermark)
        wide = wide if chained else wide.withWatermark("order_ts", watermark)
    joined = interval_join(pay, wide, ("pay_order_id", "order_id"), ("callback_ts", "order_ts"), before_s, after_s,
                           sliced=False)
    merged = {
        "order_create_time": F.col("create_time"),
        "order_id": F.coalesce("pay_order_id", "order_id"),
        "user_id": F.coalesce("pay_user_id", "user_id"),
        "total_amount": F.coalesce("pay_total_amount", "total_amount"),
    }
    return joined.select(
        *[merged[c].alias(c) if c in merged else F.col(c) for c in schemas.column_names(schemas.PAYMENT_WIDE)],
        "callback_ts", "order_ts")


def first_non_null(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Merge two wide tables by key: the left value, or the right one if null."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on, "left").select(
        *[F.col(f"a.{c}") if c in keys or c not in right.columns else F.coalesce(f"a.{c}", f"b.{c}").alias(c)
          for c in left.columns])
