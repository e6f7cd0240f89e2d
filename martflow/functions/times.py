"""Timestamps, day keys, labels and ages (all in the session time zone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, TimestampType

from martflow.settings import DAY_FORMAT, TIMESTAMP_FORMAT


def from_text(c: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp; unreadable text is null."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(TIMESTAMP_FORMAT))


def time_column(df: DataFrame, name: str) -> Column:
    """A time column that holds timestamps (tables) or text (topics).

    A timestamp is handed on as it is, with the watermark it may carry.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, TimestampType):
        return F.col(name)
    return from_text(name) if isinstance(kind, StringType) else F.col(name).cast("timestamp")


def to_text(c: str | Column) -> Column:
    return F.date_format(c, TIMESTAMP_FORMAT)


def from_millis(c: str | Column) -> Column:
    return F.timestamp_millis(F.col(c) if isinstance(c, str) else c)


def day_key(c: str | Column) -> Column:
    """Timestamp to its ``yyyyMMdd`` day."""
    return F.date_format(c, DAY_FORMAT)


def age_in_years(birthday: str | Column, as_of: Column | None = None) -> Column:
    """Completed years; a 29 February birthday counts from 1 March."""
    birthday = F.to_date(F.col(birthday) if isinstance(birthday, str) else birthday)
    as_of = F.current_date() if as_of is None else as_of
    return F.timestamp_diff("YEAR", birthday.cast("timestamp"), as_of.cast("timestamp")).cast("int")


def stat_time() -> Column:
    """Epoch milliseconds at which a statistics row is produced."""
    return F.unix_millis(F.current_timestamp())
