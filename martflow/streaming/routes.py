"""The routing table beside the stream of change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from martflow.operators.routing import lookup_type
from martflow.sources.changes import live_route, route_changes


def with_routes(rows: DataFrame, config_changes: DataFrame, row: str = "row") -> DataFrame:
    """A stream of change records (a struct column) and, next to it in a column
    ``route``, the live route of every (table, operation) that a record or a
    configuration change of the micro-batch names; for update mode.

    The configuration feed is a stream like any other: its snapshot comes first, then
    its changes, each read once.  The state is an aggregate that holds the last
    configuration row of a (table, operation); records take part with their key
    alone, which makes update mode hand out the routes they need.
    """
    config = route_changes(config_changes)
    named = rows.filter(F.col(row).isNotNull()).select(
        F.col(f"{row}.table").alias("source_table"), lookup_type(f"{row}.type").alias("operate_type"),
        *[F.lit(None).cast(config.schema[c].dataType).alias(c) for c in ("last", "ts_ms")])
    last = config.unionByName(named).groupBy("source_table", "operate_type").agg(F.max_by("last", "ts_ms").alias("last"))
    routes = live_route(last).select(F.struct("*").alias("route"))
    return rows.unionByName(routes, allowMissingColumns=True)
