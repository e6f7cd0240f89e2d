"""Streams over several micro-batches: equal to the batch twins, order, lateness, SQL."""

import json
import os

import pytest
from pyspark.sql import functions as F

from martflow.functions.times import to_text
from martflow.operators import routing, stats, visits
from martflow.sources import testdata as td
from martflow.sources.tables import dim_rows
from martflow.sources.topics import FileBus, topic_view, with_clock
from martflow.streaming import visits as streaming_visits
from martflow.streaming.replay import drain, run_repair, run_update

PARTS = 4
HOURS4 = 4 * 3600


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """sf0.001 events, one file per quarter of the month, in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = F.dayofmonth("ts")
    for i in range(PARTS):
        part = rows.filter((days > i * 8) & (days <= (i + 1) * 8))
        part.coalesce(1).write.parquet(f"{folder}/stage{i}")
        name = next(f for f in os.listdir(f"{folder}/stage{i}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.link(f"{folder}/stage{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{folder}/in"


def logs(spark, folder, stream):
    schema = spark.read.parquet(folder).schema
    if stream:
        return td.raw_logs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    return td.raw_logs(spark.read.parquet(folder))


def keys(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_repair_over_micro_batches(spark, events):
    pick = lambda df: df.select("common.mid", "ts", "common.is_new")
    want = keys(pick(visits.repair_is_new(logs(spark, events, False))))
    where = run_repair(logs(spark, events, True), "repair")
    assert keys(pick(spark.read.option("recursiveFileLookup", "true").parquet(where))) == want


def test_unique_visitors_over_micro_batches(spark, events):
    pick = lambda df: df.select("common.mid", "ts", "page.page_id")
    want = keys(pick(visits.unique_visitors(routing.page_logs(logs(spark, events, False)))))
    stream = streaming_visits.unique_visitors(routing.page_logs(logs(spark, events, True)))
    assert keys(drain(pick(stream), "uv", run=run_update)) == want


def test_bounces_over_micro_batches(spark, events):
    pages = routing.page_logs(logs(spark, events, False))
    last = pages.agg(F.max("ts")).first()[0]
    slot = HOURS4 * 1000
    closed = visits.bounces(pages, HOURS4).filter(F.col("ts") - F.col("ts") % slot + 2 * slot <= last)
    want = keys(closed.select("common.mid", "ts"))
    stream = visits.bounces(routing.page_logs(logs(spark, events, True)), HOURS4, watermark="0 seconds")
    assert keys(drain(stream.select("common.mid", "ts"), "jump")) == want and want


def write_pages(folder, batches):
    os.makedirs(folder, exist_ok=True)
    for i, seconds in enumerate(batches):
        with open(f"{folder}/{i}.json", "w") as f:
            for s in seconds:
                f.write(json.dumps({"common": {"mid": "m", "is_new": "0", "vc": "v", "ch": "c", "ar": "a"},
                                    "page": {"page_id": "p", "last_page_id": None, "during_time": 1}, "ts": s * 1000}) + "\n")
        os.utime(f"{folder}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


@pytest.mark.parametrize("batches, want", [
    ([[1, 2, 11, 12], [25], [40]], {"00": 2, "10": 2, "20": 1}),
    ([[12, 1, 11, 2], [25], [40]], {"00": 2, "10": 2, "20": 1}),      # shuffled arrival
    ([[1, 11, 12], [2, 25], [40]], {"00": 2, "10": 2, "20": 1}),      # late, but within three seconds
    # Beyond it: dropped.  Lateness is judged by the watermark of the batch before.
    ([[1, 2, 11, 25], [26], [12, 1], [40]], {"00": 2, "10": 1, "20": 2}),
])
def test_order_and_lateness(spark, tmp_path, batches, want):
    from martflow import schemas

    folder = write_pages(str(tmp_path / "in"), batches)
    pages = spark.readStream.schema(schemas.PAGE_LOG).option("maxFilesPerTrigger", 1).json(folder)
    none = pages.filter("false")
    out = drain(stats.visitor_stats(stats.visitor_rows(pages, none, none), watermark="3 seconds"), "late")
    assert {r.stt[-2:]: r.pv_ct for r in out.collect()} == want


def test_sql_over_a_topic(spark, tmp_path):
    bus = FileBus(str(tmp_path))
    folder = f"{bus.root}/intake/topic=pages"
    os.makedirs(folder)
    with open(f"{folder}/1.txt", "w") as f:
        for ts, item in ((1000, "red phone"), (2000, "red"), (3000, None), (60000, "x")):
            f.write(json.dumps({"common": {"mid": "m"}, "page": {"page_id": "good_list", "item": item}, "ts": ts}) + "\n")
    topic_view(spark, bus, "intake", "pages", "page_view",
               "common MAP<STRING, STRING>, page MAP<STRING, STRING>, ts BIGINT", "timestamp_millis(ts)", "3 seconds")
    words = spark.sql("""
        SELECT explode(split(page['item'], ' ')) AS keyword, rowtime FROM page_view
        WHERE page['page_id'] = 'good_list' AND page['item'] IS NOT NULL""")
    words.createOrReplaceTempView("keyword_view")
    counts = spark.sql("""
        SELECT keyword, count(*) AS ct, 'SEARCH' AS source, window.start AS start FROM keyword_view
        GROUP BY window(rowtime, '10 seconds'), keyword""")
    out = drain(counts.select("keyword", "ct", "source", to_text("start").alias("stt")), "sql")
    assert {(r.keyword, r.ct, r.stt) for r in out.collect()} == {
        ("red", 2, "1970-01-01 00:00:00"), ("phone", 1, "1970-01-01 00:00:00")}


def test_dimension_rows_by_several_keys(spark):
    dim = spark.createDataFrame([("x", "y", 1), ("x", "z", 2)], "a string, b string, v int")
    assert [r.v for r in dim_rows(dim, a="x", b="z").collect()] == [2]


def write_rows(folder, batches):
    """JSON lines, one file per micro-batch and input; an empty batch is an empty file."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        with open(f"{folder}/{i}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(f"{folder}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def clock(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


def seven_inputs(spark, tmp_path, **rows):
    """The inputs of product statistics: {name: a list of rows per micro-batch}."""
    from martflow import schemas

    inputs = {"pages": schemas.PAGE_LOG, "favors": schemas.SKU_EVENT, "carts": schemas.SKU_EVENT, "order_wide": schemas.ORDER_WIDE,
              "payment_wide": schemas.PAYMENT_WIDE, "refunds": schemas.REFUND, "comments": schemas.COMMENT}
    for name in inputs:
        write_rows(f"{tmp_path}/{name}", rows[name])
    return {name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}")
            for name, schema in inputs.items()}


def one_of_each(second, far):
    """A row of every input at a second, and one far ahead that closes windows."""
    start = 1704067200000
    page = lambda s: {"page": {"page_id": "good_detail", "item": "7"}, "ts": start + s * 1000}
    sku = lambda s, **more: {"sku_id": 7, "create_time": clock(s), **more}
    line = lambda s: sku(s, detail_id=s, order_id=s, sku_num=2, split_total_amount=5.5)
    paid = lambda s: {**line(s), "payment_id": s, "callback_time": clock(s)}
    refund = lambda s: sku(s, order_id=s, refund_amount=1.25)
    makers = {"pages": page, "favors": sku, "carts": sku, "order_wide": line, "payment_wide": paid, "refunds": refund,
              "comments": lambda s: sku(s, appraise="1201")}
    return {name: ([make(second)], [make(far)]) for name, make in makers.items()}


METRICS = ["click_ct", "favor_ct", "cart_ct", "order_sku_num", "order_ct", "paid_order_ct", "refund_order_ct", "comment_ct",
           "good_comment_ct"]


def test_each_of_seven_inputs_may_lag(spark, tmp_path):
    """Pages run 20 s and more ahead of everything else, and all of it still counts."""
    rows = {name: [early, [], late] for name, (early, late) in one_of_each(5, 300).items()}
    rows["pages"] = [rows["pages"][0], rows["pages"][2], []]                        # far ahead at once
    for name in ("favors", "carts", "refunds", "comments"):
        rows[name] = [[], rows[name][0], rows[name][2]]                             # behind the pages
    out = drain(stats.product_stats(stats.product_rows(**seven_inputs(spark, tmp_path, **rows), watermark="3 seconds")), "seven")
    assert [(r.stt, *[r[m] for m in METRICS]) for r in out.collect()] == [("2024-01-01 00:00:00", 1, 1, 1, 2, 1, 1, 1, 1, 1)]


def test_a_replayed_batch_changes_no_sum(spark, tmp_path):
    """The second micro-batch delivers the first again: keyed records count once."""
    once = one_of_each(5, 300)
    twice = ("order_wide", "payment_wide", "refunds")
    rows = {name: [early, early if name in twice else [], late] for name, (early, late) in once.items()}
    out = drain(stats.product_stats(stats.product_rows(**seven_inputs(spark, tmp_path, **rows), watermark="3 seconds")), "again")
    assert [tuple(r[m] for m in METRICS) for r in out.collect()] == [(1, 1, 1, 2, 1, 1, 1, 1, 1)]


def test_a_silent_topic_lets_the_clock_pass(spark, tmp_path):
    """Without refunds no window closes; with an idle rule the clock stands in for them."""
    rows = {name: [early, late] for name, (early, late) in one_of_each(5, 300).items()}
    rows["refunds"] = [[], []]
    inputs = seven_inputs(spark, tmp_path, **rows)
    assert drain(stats.product_stats(stats.product_rows(**inputs, watermark="3 seconds")), "held").count() == 0
    refunds = with_clock(inputs["refunds"].withColumn("create_time", F.to_timestamp("create_time")), "create_time", "3 seconds", 60)
    assert refunds.columns == inputs["refunds"].columns and refunds.isStreaming


def test_batches_are_written_once(spark, tmp_path):
    bus = FileBus(str(tmp_path))
    rows = spark.createDataFrame([("a", "t"), ("b", "u")], "value string, topic string")
    bus.write_batch(rows, "order_wide", 0)
    files = sorted(os.listdir(f"{tmp_path}/order_wide/topic=t/batch_id=0"))
    bus.write_batch(rows, "order_wide", 0)
    assert sorted(os.listdir(f"{tmp_path}/order_wide/topic=t/batch_id=0")) == files
    bus.write_batch(rows, "order_wide", 1)
    assert [r.value for r in bus.read_batch(spark, "order_wide", "t").collect()] == ["a", "a"]
