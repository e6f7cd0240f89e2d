"""New-visitor repair and unique visitors with keyed state, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martflow import settings
from martflow.functions.times import from_millis
from martflow.operators.parse import is_entry_page

# Days since 1970 that a state value can hold; clocks beyond are cut to its ends.
_FIRST, _LAST = -30_000, 69_999


def _claims(common: str = "common") -> Column:
    return F.coalesce(F.col(f"{common}.is_new") == "1", F.lit(False))


def _day(ts: str) -> Column:
    return F.greatest(F.least(F.unix_date(F.to_date(from_millis(ts))), F.lit(_LAST)), F.lit(_FIRST))


def with_first_days(rows: DataFrame, row: str = "row") -> DataFrame:
    """A stream of log rows (a struct column) and, next to it, the first day of every
    device whose claims are in the micro-batch; for update mode and ``repaired``.

    The day is that of the first micro-batch with a claim, the earliest one in it: the
    smallest (trigger time, day) of the device.  That is one number per device, kept
    for good, and an aggregate with map-side combine: neither a log row nor a device's
    share of them passes through the state or through Python.
    """
    seen = F.unix_millis(F.current_timestamp()) * (_LAST - _FIRST + 1) + _day(f"{row}.ts") - _FIRST
    claims = rows.filter(_claims(f"{row}.common")).select(F.col(f"{row}.common.mid").alias("mid"), seen.alias("seen"))
    first = claims.groupBy("mid").agg(F.min("seen").alias("seen"))
    days = first.select("mid", (F.col("seen") % (_LAST - _FIRST + 1) + _FIRST).cast("int").alias("first_day"),
                        F.lit(True).alias("is_day"))
    return rows.withColumn("is_day", F.lit(False)).unionByName(days, allowMissingColumns=True)


def repaired(batch: DataFrame, row: str = "row") -> DataFrame:
    """The log rows of a micro-batch of ``with_first_days``, the flag set right.

    A plain join by device, so a device that owns most of the batch is split over
    tasks by AQE.  Hand in a persisted batch: it is read twice.
    """
    days = batch.filter("is_day").select(F.col("mid").alias("_mid"), F.col("first_day").alias("_first"))
    logs = batch.filter(~F.col("is_day") & F.col(row).isNotNull()).select(f"{row}.*")
    columns = logs.columns
    claiming = logs.filter(_claims()).join(days, F.col("common.mid").eqNullSafe(F.col("_mid")))
    flag = F.when(_day("ts") == F.col("_first"), F.col("common.is_new")).otherwise("0")
    fixed = claiming.withColumn("common", F.col("common").withField("is_new", flag)).select(*columns)
    return logs.filter(~_claims()).unionByName(fixed)


def unique_visitors(pages: DataFrame, ttl_s: int = settings.VISITOR_STATE_TTL_S,
                    day_offset: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``operators.visits.unique_visitors``, for update mode.

    Per (device, day) the state holds the earliest entry page and the trigger
    times of the first and of the latest micro-batch that touched it.  Update
    mode hands out the groups a micro-batch touched, and a group is new just
    when the two times are equal.  The work is a JVM aggregate with map-side
    combine, so a busy device does not slow one task down.

    State lives until the watermark, ``ttl_s`` behind, has passed the day.
    ``day_offset`` shifts the day's start from UTC midnight (``"16 hours"`` for
    a zone eight hours ahead).
    """
    rows = (pages.filter(is_entry_page()).select(
        F.col("common.mid").alias("mid"), from_millis("ts").alias("t"), F.struct(*pages.columns).alias("row"),
        F.current_timestamp().alias("seen")).withWatermark("t", f"{ttl_s} seconds"))
    groups = rows.groupBy("mid", F.window("t", "1 day", "1 day", day_offset).alias("day")).agg(
        F.min_by("row", F.struct("row.ts", "row.page.page_id")).alias("row"),
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return groups.filter(F.col("first_seen") == F.col("last_seen")).select("row.*")
