"""Distinct counts that merge: a sketch per window, united for longer spans.

An exact distinct count has to see the values again for every span it is asked for.
A sketch of a few kilobytes per window and group is stored once, and days, months
or several groups are counted from the stored sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LG_SIZE = 15   # 2^15 registers: a standard error of 0.6 %; fewer values are counted almost exactly


def window_sketches(rows: DataFrame, time: str, window: str, keys: list[str], value: str | Column, lg_size: int = LG_SIZE) -> DataFrame:
    """(start, keys, sketch) per window and group; nulls are not counted.  The
    aggregate combines before its shuffle and runs on streams too."""
    sketched = rows.groupBy(F.window(time, window).alias("w"), *keys).agg(F.hll_sketch_agg(value, lg_size).alias("sketch"))
    return sketched.select(F.col("w.start").alias("start"), *keys, "sketch")


def merged(sketches: DataFrame, span: str, keys: list[str]) -> DataFrame:
    """The estimated distinct count per calendar ``span`` ("day", "month", "year") and group."""
    return (sketches.groupBy(F.date_trunc(span, "start").alias("start"), *keys)
            .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_ct")))
