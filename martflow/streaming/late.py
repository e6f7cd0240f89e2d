"""Rows that come too late for their window, found and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_open_windows(rows: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """A stream of rows and, next to it, the windows the micro-batch still adds to; for
    update mode and ``late_rows``.

    A windowed aggregate drops all rows of a window that the watermark has passed, and
    none of the others.  So the windows that a count per (window, trigger time) hands
    out in update mode are those whose rows were in time.
    """
    seen = rows.select(F.col(time).alias("_time"), F.current_timestamp().alias("_seen")).withWatermark("_time", delay)
    windows = seen.groupBy(F.window("_time", window).alias("_w"), "_seen").agg(F.count(F.lit(1)).alias("_n"))
    return (rows.withColumn("_open", F.lit(None).cast("timestamp"))
            .unionByName(windows.select(F.col("_w.start").alias("_open")), allowMissingColumns=True))


def late_rows(batch: DataFrame, time: str, window: str) -> DataFrame:
    """The rows of a micro-batch of ``with_open_windows`` that came too late, with the
    start of the window that missed them.  Rows without a time belong to no window and
    are left out.  Hand in a persisted batch."""
    rows = batch.filter(F.col("_open").isNull() & F.col(time).isNotNull()).drop("_open")
    opened = batch.filter(F.col("_open").isNotNull()).select("_open")
    missed = rows.withColumn("missed", F.window(time, window)["start"])
    return missed.join(opened, F.col("missed") == F.col("_open"), "left_anti")
