"""Change feeds: Debezium envelopes and the routing-config feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from martflow import schemas
from martflow.operators.parse import once

# Fixed operation letters of the envelope; a create is reported as an insert.
OPERATIONS = {"c": "insert", "r": "read", "u": "update", "d": "delete", "t": "truncate"}


def normalise_envelopes(messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Envelope text to ``(db, table, type, data, ...)``.

    ``data`` is the after-image and is an empty map for a delete.  ``before``
    and ``ts_ms`` ride along, so that config deletes can be honoured and the
    latest change per key can be found.
    """
    e = F.from_json(value, schemas.DEBEZIUM)
    rows = messages.select(*keep, once(e).alias("e"))
    operation = F.col("e.op")
    for letter, name in OPERATIONS.items():
        operation = F.when(F.col("e.op") == letter, name).otherwise(operation)
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        *keep,
        F.col("e.source.db").alias("db"),
        F.col("e.source.table").alias("table"),
        operation.alias("type"),
        F.coalesce("e.after", empty).alias("data"),
        F.col("e.before").alias("before"),
        F.col("e.ts_ms").alias("ts_ms"),
    )


_KEY = ("source_table", "operate_type")


def _fields() -> list[str]:
    return [f for f in schemas.column_names(schemas.TABLE_PROCESS) if f not in _KEY]


def route_changes(config_changes: DataFrame) -> DataFrame:
    """Configuration changes as (source_table, operate_type, last, ts_ms), ``last`` being
    the kind of change and the other columns.  A delete shows its before-image."""
    image = F.when(F.col("type") == "delete", F.col("before")).otherwise(F.col("data"))
    rows = config_changes.select(*[image[f].alias(f) for f in _KEY], F.struct(
        F.col("type").alias("change"), *[image[f].alias(f) for f in _fields()]).alias("last"), "ts_ms")
    return rows.filter(F.col("source_table").isNotNull() & F.col("operate_type").isNotNull())


def live_route(last: DataFrame) -> DataFrame:
    """The routes whose last change is no delete, as configuration rows."""
    return (last.filter(F.col("last").isNotNull() & (F.coalesce("last.change", F.lit("")) != "delete"))
            .select(*_KEY, *[F.col(f"last.{f}").alias(f) for f in _fields()]))


def routes(config_changes: DataFrame) -> DataFrame:
    """The live routing table: the last config row per (source table, operation).

    A deleted config row, found through its before-image, takes its route away.
    ``ts_ms`` orders the feed.
    """
    return live_route(route_changes(config_changes).groupBy(*_KEY).agg(F.max_by("last", "ts_ms").alias("last")))
