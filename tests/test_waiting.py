"""Joins and windows whose rows wait in files: those of Spark's state store, and next to nothing in it."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martflow import schemas
from martflow.operators import orders, stats
from martflow.streaming import replay
from martflow.streaming.replay import drain, run_waiting
from martflow.streaming.waiting import Input
from test_streams import clock, one_of_each, seven_inputs, write_rows

SF = "/root/testdata/sf0.001"


def head(key, second, user=1):
    return {"id": key, "user_id": user, "province_id": 2, "create_time": None if second is None else clock(second)}


def line(key, order, second):
    return {"id": key, "order_id": order, "sku_id": 3, "sku_num": 1, "split_total_amount": 5.5,
            "create_time": None if second is None else clock(second)}


def orders_and_lines(spark, folder, heads, lines):
    for name, batches in (("heads", heads), ("lines", lines)):
        write_rows(f"{folder}/{name}", batches)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/{name}")
    return read("heads", schemas.ORDER_INFO).select(*orders.HEAD_COLUMNS), read("lines", schemas.ORDER_DETAIL).select(*orders.LINE_COLUMNS)


HEADS = [[head(1, 10), head(2, 11), head(2, 11), head(7, None)],
         [head(1, 10), head(3, 14), head(2, 11, user=9)],            # a repeat in time; an update of order 2
         [head(4, 30), head(1, 10)],
         [head(5, 12), head(6, 40)],
         [head(8, 28), head(9, 26), head(1, 10)]]                    # order 9 is late, and so is the repeat
LINES = [[line(11, 1, 12), line(21, 2, 20), line(71, 7, 10)],
         [line(12, 1, 14), line(31, 3, 15), line(12, 1, 14)],
         [line(41, 4, 33), line(22, 2, 12), line(31, 3, 15), line(None, 4, 31)],
         [line(51, 5, 12), line(42, 4, 34), line(13, 1, 14), line(61, 6, None)],
         [line(81, 8, 30), line(91, 9, 30), line(14, 1, 14)]]


def test_rows_that_wait_in_files_join_as_those_in_state(spark, tmp_path):
    heads, lines = orders_and_lines(spark, tmp_path, HEADS, LINES)
    picked = ("detail_id", "order_id", "user_id", "create_time", "detail_ts")
    want = drain(orders.order_lines(heads, lines, 5, 5, watermark="3 seconds", replayed=True).select(*picked), "state")
    inputs = {"heads": Input(heads, "create_time", 5, ("id",)), "lines": Input(lines, "create_time", 5, ("id",))}
    kept = []

    def finish(waiting, batch, batch_id):
        rows = waiting.joined(batch, batch_id, lambda h, d: orders.order_lines(h, d, 5, 5).select(*picked))
        kept.append(waiting.folder)
        return rows

    got = spark.read.option("recursiveFileLookup", "true").parquet(run_waiting(inputs, "files", finish))
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) == len(set(rows)) == 11
    left = {b: sorted(os.listdir(f"{kept[0]}/{b}")) for b in ("0", "4")}
    assert "input=heads" not in left["0"] and "input=heads" in left["4"]   # what no row can meet any more is gone


def test_a_micro_batch_that_runs_again_gives_its_rows_again(spark, tmp_path):
    heads, lines = orders_and_lines(spark, tmp_path, HEADS, LINES)
    inputs = {"heads": Input(heads, "create_time", 5, ("id",)), "lines": Input(lines, "create_time", 5, ("id",))}
    join = lambda h, d: orders.order_lines(h, d, 5, 5).select("detail_id", "order_id", "user_id")

    def finish(waiting, batch, batch_id):
        rows = lambda: sorted(map(str, waiting.joined(batch, batch_id, join).collect()))
        assert rows() == rows()
        return waiting.joined(batch, batch_id, join)

    assert spark.read.option("recursiveFileLookup", "true").parquet(run_waiting(inputs, "again", finish)).count() == 11


def test_windows_of_rows_that_wait_in_files(spark, tmp_path):
    """Pages run ahead and records come again, as in the tests of the streamed statistics."""
    rows = {name: [early, [], late] for name, (early, late) in one_of_each(5, 300).items()}
    rows["pages"] = [rows["pages"][0], rows["pages"][2], []]
    for name in ("favors", "carts", "comments"):
        rows[name] = [[], rows[name][0], rows[name][2]]
    for name in ("order_wide", "payment_wide", "refunds"):
        rows[name][1] = rows[name][0]
    inputs = {name: Input(df, replay.PRODUCT_TIMES[name][0], 10, replay.PRODUCT_TIMES[name][1:], millis=name == "pages")
              for name, df in seven_inputs(spark, tmp_path, **rows).items()}
    where = run_waiting(inputs, "windows", lambda waiting, batch, batch_id: stats.product_stats(
        stats.product_rows(**waiting.closed(batch, batch_id, "10 seconds")), "10 seconds"))
    out = spark.read.option("recursiveFileLookup", "true").parquet(where).collect()
    counts = ("click_ct", "favor_ct", "cart_ct", "order_sku_num", "order_ct", "paid_order_ct", "refund_order_ct", "comment_ct")
    assert [(r.stt, *[r[c] for c in counts]) for r in out] == [("2024-01-01 00:00:00", 1, 1, 1, 2, 1, 1, 1, 1)]


@pytest.mark.parametrize("name", ["stream_order_wide_dims", "stream_product_stats", "stream_province_stats", "stream_payment_wide",
                                  "stream_order_join"])
def test_joins_and_sums_of_large_tables_keep_a_time_per_input_in_state(spark, monkeypatch, name):
    state = []
    ended = StreamingQuery.awaitTermination

    def await_end(query, *args):
        done = ended(query, *args)
        state.append(max((o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]), default=0))
        return done

    monkeypatch.setattr(StreamingQuery, "awaitTermination", await_end)
    monkeypatch.setattr(replay, "_slices", lambda *_: 2)
    rows = sorted(map(str, getattr(replay, name)(spark, SF).collect()))
    assert rows and max(state) <= 7
    if name in ("stream_order_join", "stream_order_wide_dims"):   # test_replay_size.py compares the others
        monkeypatch.setattr(replay, "_slices", lambda *_: 1)
        assert rows == sorted(map(str, getattr(replay, name)(spark, SF).collect()))
