"""Windowed statistics: metric rows, unions and aggregates.

Distinct order counts are taken in two steps, first per (window, group, order)
and then per (window, group).  Both steps combine before their shuffle, a hot
product or province spreads over its orders, no set is held in one row, and the
same plan runs as chained streaming aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martflow import settings
from martflow.functions.text import words
from martflow.functions.times import from_millis, time_column, to_text
from martflow.operators.repeats import each_once
from martflow.sources.topics import with_clock

_SUM = "decimal(28,2)"


def _windowed(df: DataFrame, window: str, watermark: str | None) -> tuple[DataFrame, Column]:
    df = df.withWatermark("ts", watermark) if watermark else df
    return df, F.window("ts", window).alias("w")


def _bounds() -> list[Column]:
    return [to_text("w.start").alias("stt"), to_text("w.end").alias("edt")]


# --- visitors ------------------------------------------------------------------

_VISITOR_METRICS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
_VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]
_PAGE_METRICS = {"pv_ct": "1", "sv_ct": "if(coalesce(page.last_page_id, '') = '', 1, 0)",
                 "dur_sum": "coalesce(page.during_time, 0)"}


def _visitor_rows(logs: DataFrame, *keep: str, **metrics: str) -> DataFrame:
    return logs.selectExpr(
        "timestamp_millis(ts) AS ts", *keep, *[f"common.{k} AS {k}" for k in _VISITOR_KEYS],
        *[f"CAST({metrics.get(m, '0')} AS BIGINT) AS {m}" for m in _VISITOR_METRICS])


def _late(rows: DataFrame, watermark: str) -> DataFrame:
    """A watermark of the input's own: the slowest input then holds the windows open."""
    return rows.withWatermark("ts", watermark)


def visitor_rows(pages: DataFrame, uniques: DataFrame, jumps: DataFrame, watermark: str | None = None) -> DataFrame:
    """One metric row per page, unique visitor and bounce.

    With a ``watermark`` each input has its own.  An input without any row yet
    holds all windows open.  A unique visitor that is delivered again counts once.
    """
    if watermark:
        first = each_once(_visitor_rows(uniques, "common.mid AS mid", uv_ct="1"), "ts", ["mid"], watermark).drop("mid")
        pages, jumps = _late(_visitor_rows(pages, **_PAGE_METRICS), watermark), _late(_visitor_rows(jumps, uj_ct="1"), watermark)
        return pages.unionByName(first).unionByName(jumps)
    parts = [_visitor_rows(pages, **_PAGE_METRICS), _visitor_rows(uniques, uv_ct="1"), _visitor_rows(jumps, uj_ct="1")]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def visitor_stats(rows: DataFrame, window: str = settings.STATS_WINDOW, watermark: str | None = None) -> DataFrame:
    rows, w = _windowed(rows, window, watermark)
    sums = rows.groupBy(w, *_VISITOR_KEYS).agg(*[F.sum(m).alias(m) for m in _VISITOR_METRICS])
    return sums.select(*_bounds(), *_VISITOR_KEYS, *_VISITOR_METRICS)


# --- products --------------------------------------------------------------------

_COUNTS = ["display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct"]
_AMOUNTS = ["order_amount", "payment_amount", "refund_amount"]
# Which distinct-order count an order id feeds.
_ORDER_KINDS = {"order": "order_ct", "paid": "paid_order_ct", "refund": "refund_order_ct"}


def _product_rows(df: DataFrame, ts: str, sku: str = "sku_id", kind: str | None = None,
                  **metrics: str) -> DataFrame:
    """SQL expressions by metric; the others are zero.  ``ts`` is a time column;
    ``kind`` says which distinct-order count the row's ``order_id`` feeds."""
    order = [f"'{kind}'", "order_id"] if kind else ["NULL", "NULL"]
    return df.withColumn("row_time", time_column(df, ts)).selectExpr(
        "row_time AS ts", f"try_cast({sku} AS BIGINT) AS sku_id",
        f"CAST({order[0]} AS STRING) AS order_kind", f"CAST({order[1]} AS BIGINT) AS order_id",
        *[f"CAST({metrics.get(m, '0')} AS BIGINT) AS {m}" for m in _COUNTS],
        # Whole hundredths: sums of longs stay on the fast path, sums of decimals do not.
        *[f"CAST({metrics.get(m, '0')} * 100 AS BIGINT) AS {m}" for m in _AMOUNTS])


def _timed(df: DataFrame, time: str, keys: list[str], watermark: str | None, idle_s: float | None) -> DataFrame:
    """The input with its time column as a timestamp and a watermark of its own;
    records with ``keys`` count once if they are delivered again."""
    df = df.withColumn(time, time_column(df, time))
    if watermark is None:
        return df
    timed = with_clock(df, time, watermark, idle_s)
    return each_once(timed, time, keys) if keys else timed


def page_rows(pages: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row per click and exposure, from one reading of the pages.

    On a stream every page moves the watermark, not only clicks and exposures.
    """
    timed = pages.select("page", "displays", from_millis("ts").alias("at"))
    timed = timed.withWatermark("at", watermark) if watermark else timed
    metric = lambda sku, click: F.struct(sku.alias("sku"), F.lit(click).alias("click"))
    shown = F.transform(F.filter("displays", lambda d: d["item_type"] == settings.ITEM_SKU), lambda d: metric(d["item"], 0))
    clicked = F.when(F.col("page.page_id") == settings.PAGE_GOOD_DETAIL, F.array(metric(F.col("page.item"), 1)))
    rows = timed.select("at", F.explode(F.concat(*[F.coalesce(m, F.array()) for m in (clicked, shown)])).alias("m"))
    return _product_rows(rows, "at", "m.sku", click_ct="m.click", display_ct="1 - m.click")


def favor_rows(favors: DataFrame) -> DataFrame:
    return _product_rows(favors, "create_time", favor_ct="1")


def cart_rows(carts: DataFrame) -> DataFrame:
    return _product_rows(carts, "create_time", cart_ct="1")


def order_rows(order_wide: DataFrame) -> DataFrame:
    return _product_rows(order_wide, "create_time", kind="order",
                         order_sku_num="sku_num", order_amount="split_total_amount")


def payment_rows(payment_wide: DataFrame) -> DataFrame:
    return _product_rows(payment_wide, "callback_time", kind="paid",
                         payment_amount="split_total_amount")


def refund_rows(refunds: DataFrame) -> DataFrame:
    return _product_rows(refunds, "create_time", kind="refund", refund_amount="refund_amount")


def comment_rows(comments: DataFrame) -> DataFrame:
    return _product_rows(comments, "create_time", comment_ct="1",
                         good_comment_ct=f"if(appraise = '{settings.APPRAISE_GOOD}', 1, 0)")


def product_rows(pages: DataFrame, favors: DataFrame, carts: DataFrame, order_wide: DataFrame,
                 payment_wide: DataFrame, refunds: DataFrame, comments: DataFrame,
                 watermark: str | None = None, idle_s: float | None = None) -> DataFrame:
    """One metric row per click, exposure, favourite, cart addition, ordered
    line, paid line, refund and comment.

    With a ``watermark`` each of the seven inputs has one of its own, and a window
    stays open for the slowest: what comes through further jobs, or lies in a topic
    that lags, still counts.  An input without any row holds all windows, or,
    with ``idle_s``, for so many seconds (``sources.topics.with_clock``).  Ordered and paid
    lines and refunds count once if they are delivered again; favourites, cart
    additions and comments have no key to tell a repeat by.
    """
    timed = lambda df, time, *keys: _timed(df, time, list(keys), watermark, idle_s)
    parts = [page_rows(pages, watermark), favor_rows(timed(favors, "create_time")), cart_rows(timed(carts, "create_time")),
             order_rows(timed(order_wide, "create_time", *_of(order_wide, "detail_id", "order_id"))),
             payment_rows(timed(payment_wide, "callback_time", *_of(payment_wide, "payment_id", "detail_id"))),
             refund_rows(timed(refunds, "create_time", "order_id", "sku_id")), comment_rows(timed(comments, "create_time"))]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _of(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def product_stats(rows: DataFrame, window: str = settings.STATS_WINDOW, watermark: str | None = None) -> DataFrame:
    rows, w = _windowed(rows, window, watermark)
    per_order = rows.groupBy(w, "sku_id", "order_kind", "order_id").agg(
        *[F.sum(m).alias(m) for m in _COUNTS + _AMOUNTS])
    has_order = F.col("order_id").isNotNull()
    totals = per_order.groupBy("w", "sku_id").agg(
        *[F.sum(m).alias(m) for m in _COUNTS],
        *[(F.sum(m).cast("decimal(26,0)") / F.lit(100).cast("decimal(3,0)")).cast(_SUM).alias(m) for m in _AMOUNTS],
        *[F.sum(F.when(has_order & (F.col("order_kind") == kind), 1).otherwise(0)).cast("bigint").alias(name)
          for kind, name in _ORDER_KINDS.items()])
    return totals.select(*_bounds(), "sku_id", *_COUNTS, *_AMOUNTS, *_ORDER_KINDS.values())


# --- provinces -------------------------------------------------------------------

_PROVINCE_KEYS = {"province_id": "province_id", "province_name": "province_name",
                  "province_area_code": "area_code", "province_iso_code": "iso_code",
                  "province_3166_2_code": "iso_3166_2"}


def province_stats(order_wide: DataFrame, window: str = settings.STATS_WINDOW,
                   watermark: str | None = None, replayed: bool = False) -> DataFrame:
    """``replayed`` input may deliver a line again: it counts once."""
    timed = order_wide.withColumn("create_time", time_column(order_wide, "create_time"))
    if replayed:
        timed, watermark = each_once(timed, "create_time", ["detail_id"], watermark), None
    rows = timed.select(F.col("create_time").alias("ts"), "order_id", "split_total_amount",
                        *[F.col(c).alias(n) for c, n in _PROVINCE_KEYS.items()])
    rows, w = _windowed(rows, window, watermark)
    keys = list(_PROVINCE_KEYS.values())
    per_order = rows.groupBy(w, *keys, "order_id").agg(F.sum("split_total_amount").alias("amount"))
    totals = per_order.groupBy("w", *keys).agg(
        F.sum("amount").cast(_SUM).alias("order_amount"), F.count("order_id").alias("order_count"))
    return totals.select(*_bounds(), *keys, "order_amount", "order_count")


# --- keywords --------------------------------------------------------------------


def searches(pages: DataFrame, watermark: str | None = None) -> DataFrame:
    """Search texts with their time: list pages that carry an item.

    On a stream every page moves the watermark, not only searches.  Spark pushes
    a filter below the watermark unless it uses the event time, hence its form.
    """
    is_search = (F.col("page.page_id") == settings.PAGE_GOOD_LIST) & F.col("page.item").isNotNull()
    if watermark is None:
        return pages.filter(is_search).select(F.col("page.item").alias("full_word"), from_millis("ts").alias("ts"))
    timed = pages.select("page", from_millis("ts").alias("ts")).withWatermark("ts", watermark)
    return timed.filter(F.when(is_search, F.col("ts")).isNotNull()).select(F.col("page.item").alias("full_word"), "ts")


def keywords(search_rows: DataFrame, splitter=words) -> DataFrame:
    """One row per word of each search; a text without words yields none."""
    return search_rows.select(F.explode(splitter(F.col("full_word"))).alias("keyword"), "ts")


def keyword_stats(keyword_rows: DataFrame, window: str = settings.STATS_WINDOW,
                  source: str = settings.KEYWORD_SEARCH) -> DataFrame:
    counts = keyword_rows.groupBy(F.window("ts", window).alias("w"), "keyword").agg(F.count("*").alias("ct"))
    return counts.select("keyword", "ct", F.lit(source).alias("source"), *_bounds())
