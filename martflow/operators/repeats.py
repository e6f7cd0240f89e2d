"""Records that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def each_once(rows: DataFrame, time: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Each record once, known by its keys and a hash of its columns.

    A replayed record is equal to the first one in every column; records that share
    a key and differ, as updates of a row do, all stay.  On a stream ``time`` gets
    the ``watermark``, or has one already: the state holds a record until the
    watermark has passed it by the delay, and what comes later than that is dropped
    as late, so no replay counts twice whenever it comes.
    """
    marked = rows.withColumn("_content", F.xxhash64(*[F.col(c) for c in rows.columns]))
    if not rows.isStreaming:
        return marked.dropDuplicates([*keys, "_content"]).drop("_content")
    timed = marked.withWatermark(time, watermark) if watermark else marked
    return timed.dropDuplicatesWithinWatermark([*keys, "_content"]).drop("_content")
