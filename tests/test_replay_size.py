"""Replays of large tables: each micro-batch computed once, state that holds a slice and not the table."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martflow import settings
from martflow.sources import testdata as td
from martflow.sources.topics import FileBus, in_time_order, keep_order
from martflow.streaming import jobs, replay
from martflow.streaming.replay import _as_topic


def test_order_wide_runs_its_join_once(spark, tmp_path):
    at = lambda c: F.timestamp_seconds(F.col(c) * 60 + 60)
    heads = spark.range(40).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"), at("id").alias("o_orderdate"))
    lines = spark.range(40).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 5).alias("l_partkey"),
        F.lit(2.0).alias("l_quantity"), F.lit(3.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
        at("id").alias("l_shipdate"))
    site = jobs.Site(FileBus(str(tmp_path / "bus")), str(tmp_path / "checkpoints"), str(tmp_path / "dims"),
                     str(tmp_path / "tables"), trigger={"availableNow": True})
    for name, columns in jobs.DIMENSIONS.values():
        site.dim_table(name, list(columns), ["id"]).create(spark)
    records = _as_topic(td.order_info(heads), settings.FACT_ORDER_INFO).unionByName(
        _as_topic(td.order_detail(lines), settings.FACT_ORDER_DETAIL))
    site.bus.write_batch(records, "base_db", 0)
    query = jobs.order_wide(spark, site)
    query.awaitTermination()
    joined = [o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]
              if o["operatorName"] == "symmetricHashJoin"]
    assert sum(joined) == 80
    assert site.bus.read_batch(spark, "order_wide", settings.DWM_ORDER_WIDE).count() == 40
    assert not (tmp_path / "checkpoints/_batches/order_wide").exists()


@pytest.mark.parametrize("name", ["stream_payment_wide", "stream_province_stats", "stream_product_stats",
                                  "stream_replayed_orders", "stream_keyword_stats", "stream_keyword_stats_sql"])
def test_slices_give_the_rows_of_the_whole(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.001"
    state, shapes = [], []
    ended = StreamingQuery.awaitTermination

    def await_end(query, *args):
        done = ended(query, *args)
        state.append(max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]))
        return done

    monkeypatch.setattr(StreamingQuery, "awaitTermination", await_end)
    for slices in (1, 3):
        monkeypatch.setattr(replay, "_slices", lambda *_: slices)
        state.clear()
        rows = getattr(replay, name)(spark, sf)
        shapes.append((max(state), sorted(map(str, rows.collect()))))
    (whole, want), (sliced, got) = shapes
    assert got == want and want
    assert sliced < 0.8 * whole


def test_product_stats_joins_orders_and_lines_once(spark, tmp_path, monkeypatch):
    at = F.timestamp_seconds(F.col("id") * 60 + 60)
    ids = spark.range(40)
    ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"),
               F.when(F.col("id") < 20, "F").otherwise("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
               at.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    ids.select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 5).alias("l_partkey"),
               F.lit(2.0).alias("l_quantity"), F.lit(3.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
               F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), at.alias("l_shipdate")
               ).write.parquet(f"{tmp_path}/lineitem.parquet")
    ids.select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 3).alias("user_id"),
               F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")
               ).write.parquet(f"{tmp_path}/events.parquet")
    joined = []
    ended = StreamingQuery.awaitTermination

    def await_end(query, *args):
        done = ended(query, *args)
        joined.extend(o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]
                      if o["operatorName"] == "symmetricHashJoin" and o["numRowsUpdated"])
        return done

    monkeypatch.setattr(StreamingQuery, "awaitTermination", await_end)
    replay.stream_product_stats(spark, str(tmp_path)).collect()
    assert joined == [80, 60]  # orders and lines; callbacks and widened lines


def test_order_of_files_is_that_of_their_times(spark, tmp_path):
    folder = str(tmp_path / "rows")
    in_time_order(spark.range(1000).selectExpr("999 - id AS at", "id % 3 AS n"), "at", 5).write.parquet(folder)
    assert keep_order(spark, folder)
    files = sorted((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: os.stat(f"{folder}/{f}").st_mtime_ns)
    spans = [spark.read.parquet(f"{folder}/{f}").agg(F.min("at"), F.max("at")).first() for f in files]
    assert len(spans) == 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_province_join_keeps_only_what_its_reader_needs(spark, monkeypatch):
    topics = []
    run = replay.run_batches
    monkeypatch.setattr(replay, "run_batches", lambda *a, **b: topics.append(run(*a, **b)) or topics[-1])
    assert replay.stream_province_stats(spark, "/root/testdata/sf0.001").count()
    topic = spark.read.option("recursiveFileLookup", "true").parquet(topics[0])
    kept = topic.agg(*[F.count(c).alias(c) for c in topic.columns]).first().asDict()
    assert kept["detail_id"] and kept["split_total_amount"] and kept["province_name"]
    assert not kept["total_amount"] and not kept["sku_id"] and not kept["create_date"]
