"""New-visitor repair, unique visitors and bounces.

One device may own a large share of all rows, so none of these gathers a
device's history: repair joins against a map-side-combined minimum, unique
visitors are cut to one row per task and (device, day) before the shuffle, and
bounces are found by aggregating short time slots.  Bounces run on streams as
they are; the streaming forms of the other two are in streaming.visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from martflow import settings
from martflow.functions.times import day_key, from_millis
from martflow.operators.parse import is_entry_page


def repair_is_new(logs: DataFrame) -> DataFrame:
    """A device is new only on the first day it calls itself new.

    Later rows with ``is_new='1'`` on another day become ``'0'``; rows that do
    not claim to be new neither read nor set the first day, and are not shuffled.
    """
    day = F.to_date(from_millis("ts"))
    claims = F.coalesce(F.col("common.is_new") == "1", F.lit(False))
    claiming = logs.filter(claims)
    first = claiming.groupBy(F.col("common.mid").alias("first_mid")).agg(F.min(day).alias("first_day"))
    joined = claiming.join(first, F.col("common.mid").eqNullSafe(F.col("first_mid")))
    flag = F.when(F.col("first_day") == day, "1").otherwise("0")
    fixed = joined.withColumn("common", F.col("common").withField("is_new", flag)).drop("first_mid", "first_day")
    return logs.filter(~claims).unionByName(fixed.select(*logs.columns))


def unique_visitors(pages: DataFrame) -> DataFrame:
    """The first entry page of each device and day.

    ``row_number() = 1`` plans as a group limit on both sides of the shuffle.
    """
    w = Window.partitionBy("common.mid", day_key(from_millis("ts"))).orderBy("ts", "page.page_id")
    return (pages.filter(is_entry_page()).withColumn("nth", F.row_number().over(w))
            .filter(F.col("nth") == 1).drop("nth"))


def bounces(pages: DataFrame, timeout_s: int = settings.BOUNCE_TIMEOUT_S, watermark: str | None = None) -> DataFrame:
    """Entry pages that no other row of the device follows within the timeout.

    The next row counts whatever its page is: a named page completes the visit,
    an unnamed one breaks the pattern, and either way nothing is emitted.  A row
    exactly ``timeout_s`` later is too late.

    Time is cut into slots of one timeout.  Two rows of a device in one slot are
    less than a timeout apart, so only the last row of a slot can be a bounce,
    and only the first row of the slot after it can prevent that.  Sliding
    windows of two slots hold both: a plain aggregate with map-side combine,
    however many rows the device has, and the same on a stream (``watermark``).
    """
    time = from_millis("ts")
    rows = pages.select(F.col("common.mid").alias("mid"), time.alias("t"), F.struct(*pages.columns).alias("row"))
    if watermark:
        rows = rows.withWatermark("t", watermark)
    slots = F.window("t", f"{2 * timeout_s} seconds", f"{timeout_s} seconds")
    rows = rows.select("mid", "row", slots.alias("slots"))
    second_slot = F.unix_millis("slots.start") + timeout_s * 1000
    ts, own = F.col("row.ts"), F.col("row.ts") < second_slot
    order = F.when(own, F.struct("row.ts", "row.page.page_id"))
    last = (rows.groupBy("mid", "slots")
            .agg(F.max_by("row", order).alias("row"), F.min(F.when(~own, ts)).alias("next_ts")))
    return (last.filter(F.col("row").isNotNull() & is_entry_page("row.page.last_page_id")
                        & (F.col("next_ts").isNull() | (F.col("next_ts") - F.col("row.ts") >= timeout_s * 1000)))
            .select("row.*"))
