"""The batch warehouse: from raw inputs to the four statistics tables.

A layer that several consumers read is written once to the shared folder
(``materialize``), as the streaming jobs publish it to a topic once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from martflow import schemas, settings
from martflow.functions.times import time_column
from martflow.operators import enrich, orders, routing, stats, visits
from martflow.plans import dashboard
from martflow.session import materialize


@dataclass(frozen=True)
class Spans:
    """Durations of one run; the defaults are the live jobs' values."""

    window: str = settings.STATS_WINDOW
    bounce_timeout_s: int = settings.BOUNCE_TIMEOUT_S
    order_before_s: float = settings.ORDER_JOIN_BEFORE_S
    order_after_s: float = settings.ORDER_JOIN_AFTER_S
    payment_before_s: float = settings.PAYMENT_JOIN_BEFORE_S
    payment_after_s: float = settings.PAYMENT_JOIN_AFTER_S


def order_lines(order_info: DataFrame, order_detail: DataFrame, spans: Spans = Spans()) -> DataFrame:
    return orders.order_lines(order_info, order_detail, spans.order_before_s, spans.order_after_s)


def order_wide(order_info: DataFrame, order_detail: DataFrame, dims: dict[str, DataFrame],
               spans: Spans = Spans(), as_of: Column | None = None) -> DataFrame:
    return enrich.add_all(order_lines(order_info, order_detail, spans), dims, as_of)


def payment_wide(payments: DataFrame, wide: DataFrame, spans: Spans = Spans()) -> DataFrame:
    return orders.payment_wide(payments, wide, spans.payment_before_s, spans.payment_after_s)


def day_span(day: int | str, window: str) -> tuple[Column, Column]:
    """The times that windows starting on the day can hold, from and before."""
    start = F.lit(dashboard.as_date(day)).cast("timestamp")
    return start, start + F.expr(f"INTERVAL '1' DAY + INTERVAL {window}")


def _seconds(n: float) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")


def _logged(logs: DataFrame, start: Column | None, end: Column) -> DataFrame:
    cut = logs.filter(F.col("ts") < F.unix_millis(end))
    return cut if start is None else cut.filter(F.col("ts") >= F.unix_millis(start))


def visitor_stats(raw_logs: DataFrame, spans: Spans = Spans(), day: int | str | None = None) -> DataFrame:
    """Repair once, then three readers: pages, unique visitors, bounces.

    With ``day`` only windows that start on that day.  The repair reads all claims
    up to then, the rest the day alone and the timeout after it.
    """
    if day is not None:
        start, end = day_span(day, spans.window)
        last = end + _seconds(spans.bounce_timeout_s)
        raw_logs = _logged(raw_logs, None, last)
    slim = raw_logs.select("common", "start", F.struct("page.page_id", "page.last_page_id", "page.during_time")
                           .alias("page"), "ts")
    pages = routing.page_logs(visits.repair_is_new(slim)).drop("start")
    pages = materialize(pages if day is None else _logged(pages, start, last), "dwd-page-log")
    rows = stats.visitor_rows(pages, visits.unique_visitors(pages), visits.bounces(pages, spans.bounce_timeout_s))
    totals = stats.visitor_stats(rows, spans.window)
    return totals if day is None else dashboard.on_day(totals, day)


def product_stats(pages: DataFrame, favors: DataFrame, carts: DataFrame, order_info: DataFrame,
                  order_detail: DataFrame, payments: DataFrame, refunds: DataFrame, comments: DataFrame,
                  spans: Spans = Spans(), day: int | str | None = None) -> DataFrame:
    """Per-product statistics without dimensions (``enrich.add_product`` adds
    them afterwards, so lookups are per product and window, not per event).

    With ``day`` only windows that start on that day; inputs are cut to the times
    that can reach them, before any join or aggregate.
    """
    if day is not None:
        start, end = day_span(day, spans.window)
        # A payment on the day can belong to an order created on another.
        order_info, order_detail = _reached(order_info, order_detail, start - _seconds(spans.payment_before_s),
                                            end + _seconds(spans.payment_after_s), spans)
        pages = _logged(pages, start, end)
    columns = ["order_id", "sku_id", "sku_num", "split_total_amount", "create_time"]
    wide = materialize(order_lines(order_info, order_detail, spans).select(*columns), "dwm-order-wide")
    paid = _paid_lines(payments, wide, spans)
    rows = stats.product_rows(pages, favors, carts, wide, paid, refunds, comments)
    if day is not None:
        rows = rows.filter((F.col("ts") >= start) & (F.col("ts") < end))
    totals = stats.product_stats(rows, spans.window)
    return totals if day is None else dashboard.on_day(totals, day)


def _reached(order_info: DataFrame, order_detail: DataFrame, start: Column, end: Column,
             spans: Spans) -> tuple[DataFrame, DataFrame]:
    """Heads of the span and the lines that can join them."""
    return (_within(order_info, start, end), _within(
        order_detail, start - _seconds(spans.order_before_s), end + _seconds(spans.order_after_s)))


def _within(df: DataFrame, start: Column, end: Column) -> DataFrame:
    t = time_column(df, "create_time")
    return df.filter((t >= start) & (t < end))


def _paid_lines(payments: DataFrame, wide: DataFrame, spans: Spans) -> DataFrame:
    # payment_wide expects the full order_wide; columns nobody reads are null
    # here and pruned by Catalyst.
    padded = wide.selectExpr(*[f.name if f.name in wide.columns else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
                               for f in StructType.fromDDL(schemas.ORDER_WIDE)])
    return payment_wide(payments, padded, spans)


def province_stats(order_info: DataFrame, order_detail: DataFrame, provinces: DataFrame,
                   spans: Spans = Spans(), day: int | str | None = None) -> DataFrame:
    """Aggregated by province id first; names are looked up per window after.  With
    ``day`` only windows that start on that day."""
    if day is not None:
        order_info, order_detail = _reached(order_info, order_detail, *day_span(day, spans.window), spans)
    totals = stats.province_stats(order_lines(order_info, order_detail, spans), spans.window)
    totals = totals if day is None else dashboard.on_day(totals, day)
    return enrich.lookup(totals, provinces, {"province_id": "id"}, {
        "province_name": "name", "area_code": "area_code", "iso_code": "iso_code", "iso_3166_2": "iso_3166_2"})


def keyword_stats(pages: DataFrame, spans: Spans = Spans(), day: int | str | None = None) -> DataFrame:
    """With ``day`` only windows that start on that day."""
    if day is not None:
        pages = _logged(pages, *day_span(day, spans.window))
    totals = stats.keyword_stats(stats.keywords(stats.searches(pages)), spans.window)
    return totals if day is None else dashboard.on_day(totals, day)
