"""Splitting logs and routing change records by configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from martflow import settings

# --- logs --------------------------------------------------------------------


def _is_start(logs: DataFrame) -> Column:
    start = F.col("start")
    if isinstance(logs.schema["start"].dataType, MapType):
        return F.coalesce(F.size(start), F.lit(0)) > 0
    return start.isNotNull()


def start_logs(logs: DataFrame) -> DataFrame:
    return logs.filter(_is_start(logs))


def page_logs(logs: DataFrame) -> DataFrame:
    """Everything that is not a start log."""
    return logs.filter(~_is_start(logs))


def display_logs(logs: DataFrame) -> DataFrame:
    """One row per exposure on a page, with the page and its time (as text)."""
    return (page_logs(logs).select(F.explode("displays").alias("d"), F.col("page.page_id").alias("page_id"),
                                   F.col("ts").cast("string").alias("ts"))
            .select("d.*", "page_id", "ts"))


# --- change records ----------------------------------------------------------


def well_formed(changes: DataFrame) -> DataFrame:
    """Records that name a table and carry columns."""
    return changes.filter((F.length("table") > 0) & (F.size("data") > 0))


def ill_formed(changes: DataFrame) -> DataFrame:
    """The records that ``well_formed`` leaves out."""
    return changes.filter(~F.coalesce((F.length("table") > 0) & (F.size("data") > 0), F.lit(False)))


def lookup_type(operation: str = "type") -> Column:
    """Rows replayed from history route like inserts."""
    return F.when(F.col(operation) == "bootstrap-insert", "insert").otherwise(F.col(operation))


def keep_columns(data: str | Column, columns: str | Column) -> Column:
    """Only the listed columns of a change record (comma-separated list)."""
    listed = F.transform(F.split(columns, ","), lambda c: F.trim(c))
    return F.map_filter(data, lambda k, _v: F.array_contains(listed, k))


def _join_routes(changes: DataFrame, routes: DataFrame, how: str) -> DataFrame:
    r = routes.select(F.col("source_table").alias("r_table"), F.col("operate_type").alias("r_type"),
                      "sink_type", "sink_table", "sink_columns", "sink_pk")
    on = (F.col("table") == F.col("r_table")) & (lookup_type() == F.col("r_type"))
    joined = changes.join(r, on, how)
    return joined if how == "left_anti" else joined.drop("r_table", "r_type")


def route(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Tag each record with its sink and cut it to the configured columns."""
    hit = _join_routes(changes, routes, "inner")
    return hit.withColumn("data", keep_columns("data", F.col("sink_columns")))


def unrouted(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Records without a route, which are dropped; count or keep them from here."""
    return _join_routes(changes, routes, "left_anti")


def facts(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("sink_type") == settings.SINK_FACT)


def dimension_changes(routed: DataFrame, sink_table: str | None = None) -> DataFrame:
    rows = routed.filter(F.col("sink_type") == settings.SINK_DIM)
    return rows if sink_table is None else rows.filter(F.col("sink_table") == sink_table)


def as_columns(changes: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The data map as text columns.

    ``present`` names the columns the record has: one of them that is null was
    set to null, any other was left as it is.
    """
    return changes.select(*keep, *[F.col("data")[c].alias(c) for c in columns], F.map_keys("data").alias("present"))
