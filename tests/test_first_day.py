"""The state behind the streaming repair: one day per device, whatever its rows."""

import os

from pyspark.sql import functions as F

from martflow import schemas
from martflow.streaming import visits
from martflow.streaming.replay import run_repair

T0 = 1704067200000
DAY = 86_400_000
HOT = 1_000_000


def log_rows(spark, rows):
    """Page logs of a frame (mid, day, is_new)."""
    text = lambda c: F.lit(None).cast("string").alias(c)
    page = F.struct(F.lit("home").alias("page_id"), text("last_page_id"), text("item"), F.lit(1).cast("bigint").alias("during_time"))
    return rows.select(
        F.struct("mid", "is_new", *[text(c) for c in ("vc", "ch", "ar")]).alias("common"),
        F.lit(None).cast("struct<entry:string,loading_time:bigint>").alias("start"), page.alias("page"),
        F.lit(None).cast("array<struct<item:string,item_type:string>>").alias("displays"),
        (F.lit(T0) + F.col("day") * DAY + F.col("n") % 1000).alias("ts"))


def test_a_million_rows_of_one_device(spark, tmp_path):
    """Over three micro-batches: the hot device's first day is the earliest of the first
    one, an earlier day that comes later is none; rows without a device are one device."""
    folder = str(tmp_path / "in")
    hot = spark.range(HOT).select(F.lit("hot").alias("mid"), (F.col("id") % 20 + 3).alias("day"), F.lit("1").alias("is_new"), F.col("id").alias("n"))
    few = spark.createDataFrame([("a", 9, "1", 0), ("a", 8, "0", 1), ("a", 10, "1", 2), (None, 5, "1", 3), (None, 4, "1", 4),
                                 ("b", 6, None, 5)], "mid string, day long, is_new string, n long")
    later = spark.createDataFrame([("hot", 1, "1", 0), ("hot", 3, "1", 1), ("a", 8, "1", 2), ("c", 7, "1", 3)], few.schema)
    for i, rows in enumerate((hot.unionByName(few), later, later)):
        log_rows(spark, rows).coalesce(1).write.parquet(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    logs = spark.readStream.schema(schemas.PAGE_LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    out = spark.read.option("recursiveFileLookup", "true").parquet(run_repair(logs, "hot"))
    got = {(r.mid, r.day, r.is_new): r["count"] for r in out.groupBy(
        "common.mid", ((F.col("ts") - T0) / DAY).cast("int").alias("day"), "common.is_new").count().collect()}
    assert got.pop(("hot", 3, "1")) == HOT // 20 + 2 and got.pop(("hot", 1, "0")) == 2
    assert all(got.pop(("hot", d, "0")) == HOT // 20 for d in range(4, 23))
    assert got == {("a", 9, "1"): 1, ("a", 8, "0"): 3, ("a", 10, "0"): 1, (None, 5, "0"): 1, (None, 4, "1"): 1,
                   ("b", 6, None): 1, ("c", 7, "1"): 2}


def test_no_python_and_no_payload_in_the_state(spark, tmp_path):
    schema = spark.readStream.schema(schemas.PAGE_LOG).parquet(str(tmp_path))
    rows = visits.with_first_days(schema.select(F.struct("*").alias("row")))
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    aggregate = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "min(" in aggregate and "to_json" not in aggregate
