"""Event-time interval joins.

Where a key may repeat without bound on both sides, both get a time-slice key next
to the equality key: the point side falls into one slice, the interval side is
sent to the two (at most) slices its interval touches.  The slice spreads a hot key
over time, and within a key only neighbouring rows are compared.  A key that one
side holds once needs no slices: its rows pair linearly, and the output stays
partitioned by the key.  The same plan serves batch frames and streams with
watermarks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _seconds(n: float) -> Column:
    # A literal, because streaming joins derive their state bound from it.
    return F.expr(f"INTERVAL '{n}' SECOND")


def _slice(ts: Column, width_s: float) -> Column:
    # ``div`` keeps exact integers and never decreases with time.
    return F.call_function("div", F.unix_micros(ts), F.lit(int(width_s * 1_000_000)))


def interval_join(intervals: DataFrame, points: DataFrame, key: tuple[str, str], times: tuple[str, str],
                  before_s: float, after_s: float, sliced: bool = True) -> DataFrame:
    """Inner join on key, with ``point`` in ``[anchor - before_s, anchor + after_s]``.

    ``intervals`` holds the anchors; ``key`` and ``times`` name the key and time
    columns of (intervals, points), which must be distinct names.  All other
    columns pass through.  Unmatched rows vanish.  ``sliced`` alters the plan only.
    """
    (ikey, pkey), (itime, ptime) = key, times
    width = max(before_s + after_s, 1)
    low = F.col(itime) - _seconds(before_s)
    high = F.col(itime) + _seconds(after_s)
    inside = (F.col(ikey) == F.col(pkey)) & (F.col(ptime) >= low) & (F.col(ptime) <= high)
    if not sliced:
        return intervals.join(points, inside, "inner")
    left = intervals.withColumn(
        "i_slice", F.explode(F.sequence(_slice(low, width), _slice(high, width))))
    right = points.withColumn("p_slice", _slice(F.col(ptime), width))
    return left.join(right, inside & (F.col("i_slice") == F.col("p_slice")), "inner").drop("i_slice", "p_slice")
