"""The eight dashboard queries over the four statistics tables.

Each takes the table and a day (``yyyyMMdd`` number or ``yyyy-MM-dd`` text,
today if left out).  Ties in the top-N reports are broken by id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from martflow import settings
from martflow.functions.rates import bounce_rate, pages_per_visit, seconds_per_visit


def as_date(date: int | str) -> dt.date:
    text = str(date).replace("-", "")
    return dt.datetime.strptime(text, "%Y%m%d").date()


def on_day(stats: DataFrame, date: int | str | None) -> DataFrame:
    """Rows of windows that start on the day; prunes folders if there is ``dt``."""
    day = F.lit(as_date(date)) if date else F.current_date()
    if "dt" in stats.columns:
        return stats.filter(F.col("dt") == day)
    return stats.filter(F.to_date(F.col("stt").cast("timestamp")) == day)


def _money(c: str) -> Column:
    return F.sum(c).cast("decimal(28,2)").alias(c)


def _top_sales(stats: DataFrame, key: str, name: str, date, limit: int, *extra: Column) -> DataFrame:
    return (on_day(stats, date).groupBy(key, name).agg(_money("order_amount"), *extra)
            .filter(F.col("order_amount") > 0)
            .orderBy(F.desc("order_amount"), F.asc(key)).limit(limit))


def top_spu(product_stats: DataFrame, date=None, limit: int = settings.TOP_N) -> DataFrame:
    """Best-selling spus: name, amount, order count."""
    return _top_sales(product_stats, "spu_id", "spu_name", date, limit,
                      F.sum("order_ct").alias("order_ct"))


def top_category3(product_stats: DataFrame, date=None, limit: int = settings.TOP_N) -> DataFrame:
    return _top_sales(product_stats, "category3_id", "category3_name", date, limit)


def top_trademark(product_stats: DataFrame, date=None, limit: int = settings.TOP_N) -> DataFrame:
    return _top_sales(product_stats, "tm_id", "tm_name", date, limit)


def name_value(report: DataFrame, name: str, value: str) -> DataFrame:
    """A report as a (name, value) series."""
    return report.select(F.col(name).alias("name"), F.col(value).alias("value"))


def categories_and_series(report: DataFrame, name: str, value: str) -> DataFrame:
    """A top-N report as one row of two parallel arrays, largest first.

    Only for reports that carry a limit: the whole report becomes one row.
    """
    pairs = F.sort_array(F.collect_list(F.struct(value, name)), asc=False)
    return report.agg(pairs.alias("p")).select(
        F.col(f"p.{name}").alias("categories"), F.col(f"p.{value}").alias("series"))


def gmv(product_stats: DataFrame, date=None) -> DataFrame:
    """The day's order amount, 0 on a day without rows."""
    return on_day(product_stats, date).agg(
        F.coalesce(F.sum("order_amount"), F.lit(0)).cast("decimal(28,2)").alias("gmv"))


def visitors_by_hour(visitor_stats: DataFrame, date=None) -> DataFrame:
    """All 24 hours with uv, pv and new uv; hours without rows show 0."""
    metrics = ["uv_ct", "pv_ct", "new_uv"]
    new_uv = F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)
    hourly = (on_day(visitor_stats, date).groupBy(F.hour(F.col("stt").cast("timestamp")).alias("h"))
              .agg(F.sum("uv_ct").alias("uv_ct"), F.sum("pv_ct").alias("pv_ct"), F.sum(new_uv).alias("new_uv")))
    hours = visitor_stats.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return (hours.join(hourly, F.col("hour") == F.col("h"), "left")
            .select(F.lpad(F.col("hour").cast("string"), 2, "0").alias("hr"),
                    *[F.coalesce(m, F.lit(0)).alias(m) for m in metrics]))


def visitors_by_novelty(visitor_stats: DataFrame, date=None) -> DataFrame:
    """uv, pv, sv, uj and duration per ``is_new``."""
    return on_day(visitor_stats, date).groupBy("is_new").agg(
        *[F.sum(m).alias(m) for m in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")])


def new_versus_returning(visitor_stats: DataFrame, date=None) -> DataFrame:
    """Five figures as rows, new and returning visitors as columns.

    Anything but ``'1'`` counts as returning; a missing side shows 0.
    """
    is_new = F.col("is_new") == "1"
    total = lambda m, side: F.coalesce(F.sum(F.when(side, F.col(m))), F.lit(0))
    sums = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")
    old = ~F.coalesce(is_new, F.lit(False))
    one = on_day(visitor_stats, date).agg(
        *[total(m, is_new).alias(f"new_{m}") for m in sums], *[total(m, old).alias(f"old_{m}") for m in sums])
    figures = []
    for label, figure in (
        ("uv_ct", lambda s: F.col(f"{s}_uv_ct")),
        ("pv_ct", lambda s: F.col(f"{s}_pv_ct")),
        ("bounce_rate", lambda s: bounce_rate(F.col(f"{s}_uj_ct"), F.col(f"{s}_sv_ct"))),
        ("seconds_per_visit", lambda s: seconds_per_visit(F.col(f"{s}_dur_sum"), F.col(f"{s}_sv_ct"))),
        ("pages_per_visit", lambda s: pages_per_visit(F.col(f"{s}_pv_ct"), F.col(f"{s}_sv_ct"))),
    ):
        figures.append(F.struct(F.lit(label).alias("type"),
                                figure("new").cast("decimal(24,2)").alias("new_user"),
                                figure("old").cast("decimal(24,2)").alias("old_user")))
    return one.select(F.explode(F.array(*figures)).alias("f")).select("f.*")


def amount_by_province(province_stats: DataFrame, date=None) -> DataFrame:
    return (on_day(province_stats, date).groupBy("province_id", "province_name")
            .agg(_money("order_amount")).select("province_name", "order_amount"))


def hot_keywords(keyword_stats: DataFrame, date=None, limit: int = settings.TOP_N) -> DataFrame:
    """Most wanted words, each occurrence weighted by where it came from."""
    weight = F.lit(0)
    for source, points in settings.KEYWORD_WEIGHTS.items():
        weight = F.when(F.col("source") == source, points).otherwise(weight)
    return (on_day(keyword_stats, date).groupBy("keyword").agg(F.sum(F.col("ct") * weight).alias("ct"))
            .orderBy(F.desc("ct"), F.asc("keyword")).limit(limit))
