"""Statistics tables: fixed column order, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from martflow.functions.times import stat_time


def sink_rows(stats: DataFrame, columns: list[str]) -> DataFrame:
    """The table's columns in order, the write time as ``ts``, and the day ``dt``.

    Working columns that the table lacks are left out.
    """
    rows = stats.withColumn("ts", stat_time())
    return rows.select(*columns, F.to_date(F.col("stt").cast("timestamp")).alias("dt"))


def append_batch(stats: DataFrame, columns: list[str], path: str) -> None:
    """Append to a parquet table with one folder per day.

    The rebalance hint gathers a day's rows into few files, and lets AQE split
    a day that is too large for one task.
    """
    sink_rows(stats, columns).hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def write_batch(stats: DataFrame, columns: list[str], path: str, batch_id: int) -> None:
    """One micro-batch of a table, in ``batch_id`` folders that a replay replaces."""
    (sink_rows(stats, columns).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(path))


def start_append(stats: DataFrame, columns: list[str], path: str, checkpoint: str,
                 **trigger) -> StreamingQuery:
    """Stream into a parquet table, exactly once (file sink with a checkpoint)."""
    return (sink_rows(stats, columns).writeStream.outputMode("append").format("parquet")
            .partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def start_jdbc(stats: DataFrame, columns: list[str], url: str, table: str, checkpoint: str,
               batch_size: int = 5000, **trigger) -> StreamingQuery:
    """Stream into a database table; a replayed micro-batch appends again."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        (batch.select(*columns).write.mode("append").format("jdbc")
         .options(url=url, dbtable=table, batchsize=str(batch_size)).save())

    return (sink_rows(stats, columns).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
