"""Streaming queries over the given test tables, run to the end of the data.

Each reads its tables as streams, runs the streaming operators with the
``availableNow`` trigger into a file sink and returns what the sink holds.
Windows the watermark has not passed yet are not emitted, as in a live job.

A table of more than ``SLICE_BYTES`` is replayed in the order of its event time,
slice by slice: the state then holds open windows and what joins may still need,
not the whole table.  Each file of a slice is a stretch of time of its own, so no row
is late wherever a micro-batch ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from martflow import schemas, settings
from martflow.functions.text import register_word_table_function
from martflow.functions.times import day_key, from_millis, to_text
from martflow.operators import enrich, orders, parse, routing, stats
from martflow.operators import visits as shared
from martflow.plans.queries import HOURLY, YEAR_S, plain as _plain
from martflow.session import fresh_dir, input_bytes, materialize, shuffle_partitions, state_partitions_for
from martflow.sources import changes, testdata as td
from martflow.sources.topics import INTAKE, FileBus, in_time_order, keep_order, to_messages, topic_view
from martflow.streaming import jobs, late, visits
from martflow.streaming.routes import with_routes
from martflow.streaming.waiting import Input, Waiting

DELAY_S = 3
DELAY = f"{DELAY_S} seconds"
DAY_S = 86400
SLICE_BYTES = 64 << 20    # input of a micro-batch
JOIN_SLICES = 6           # each micro-batch reads what waits for the join, rows of a year at least
EVENT_SHIFT_DAYS = 8220   # moves the events of 2024 to July 2001, before the orders end
CUT = "1998-07-01"        # where two micro-batches of orders part
CONFIG_CUT = "2024-01-16"
# What the configuration turns into half-way.
CHANGED_ROUTES = [("sku_info", "insert", "hbase", "dim_sku_v2", "id,name", "id", None),
                  ("spu_info", "delete", "kafka", "dwd_spu_gone", "id", "id", None)]
GONE_ROUTES = [("user_info", "insert", "hbase", "dim_user_info", "id,name", None, None)]


def _run(writer: DataStreamWriter, where: str, inputs: Iterable[str], slices: int = 1) -> None:
    with state_partitions_for(writer._spark, inputs, slices=slices):
        writer.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_append(df: DataFrame, name: str, *inputs: str, slices: int = 1) -> str:
    """Run a stream over all present input; return the file sink's folder."""
    where = fresh_dir(df.sparkSession, name)
    _run(df.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out"), where, inputs, slices)
    return f"{where}/out"


def run_batches(df: DataFrame, name: str, finish: Callable[[DataFrame], DataFrame], *inputs: str, mode: str = "append",
                slices: int = 1) -> str:
    """The same with a last step on each micro-batch: one folder per micro-batch."""
    where = fresh_dir(df.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{where}/out/{batch_id}")

    _run(df.writeStream.outputMode(mode).foreachBatch(write), where, inputs, slices)
    return f"{where}/out"


def run_update(df: DataFrame, name: str, *inputs: str) -> str:
    """The same for a stream in update mode."""
    return run_batches(df, name, lambda batch: batch, *inputs, mode="update")


def run_waiting(inputs: dict[str, Input], name: str, finish: Callable[[Waiting, DataFrame, int], DataFrame]) -> str:
    """The same for streams whose waiting rows lie in files; ``finish`` gives the rows of a
    micro-batch."""
    spark = next(iter(inputs.values())).rows.sparkSession
    where = fresh_dir(spark, name)
    waiting = Waiting(inputs, f"{where}/waiting", DELAY_S)

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(waiting, batch, batch_id).write.mode("overwrite").parquet(f"{where}/out/{batch_id}")

    writer = waiting.stream().writeStream.outputMode("update").foreachBatch(write)
    with shuffle_partitions(spark, 1):   # of the state alone: it holds a time per input
        query = writer.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{where}/out"


def drain(df: DataFrame, name: str, *inputs: str, run=run_append, **how) -> DataFrame:
    """Run the stream and read its sink; ``inputs`` are the files it reads."""
    where = run(df, name, *inputs, **how)
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(where)


def _files(sf: str, *names: str) -> list[str]:
    return [f"{sf}/{name}.parquet" for name in names]


def _slices(spark: SparkSession, *paths: str) -> int:
    return max(1, -(-input_bytes(spark, paths) // SLICE_BYTES))


def _join_slices(spark: SparkSession, sf: str) -> int:
    return min(JOIN_SLICES, _slices(spark, *_files(sf, "orders", "lineitem")))


def _ordered(rows: DataFrame, time: str, name: str, slices: int) -> Callable[[], DataFrame]:
    """``rows`` written in the order of ``time``, to be read as streams of so many micro-batches."""
    spark = rows.sparkSession
    folder, at_once = fresh_dir(spark, name), spark.sparkContext.defaultParallelism
    in_time_order(rows, time, slices * at_once).write.parquet(folder)
    reader = lambda: spark.readStream.schema(rows.schema)
    if not keep_order(spark, folder):
        return lambda: reader().parquet(folder)
    return lambda: reader().option("maxFilesPerTrigger", at_once).parquet(folder)


def _replayed(spark: SparkSession, sf: str, name: str, time: str, slices: int, *columns: str) -> Callable[[], DataFrame]:
    """A table to be read as streams, in the order of ``time`` if it is more than a slice;
    then ``columns`` alone, if given, are written in that order."""
    if slices == 1:
        return lambda: td.table_stream(spark, sf, name)
    rows = td.table(spark, sf, name)
    return _ordered(rows.select(*columns) if columns else rows, time, f"{name}-in-order", slices)


def _facts(spark: SparkSession, sf: str, *more: str) -> tuple[Callable[[], DataFrame], Callable[[], DataFrame], int]:
    """Orders and lines to be read as streams, and in how many micro-batches: the columns
    of heads and lines, and ``more`` of the lines."""
    n = _join_slices(spark, sf)
    return (_replayed(spark, sf, "orders", "o_orderdate", n, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate"),
            _replayed(spark, sf, "lineitem", "l_shipdate", n, "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                      "l_extendedprice", "l_discount", "l_shipdate", *more), n)


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return td.raw_logs(td.table_stream(spark, sf, "events"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return routing.page_logs(_logs(spark, sf))


def run_repair(logs: DataFrame, name: str, *inputs: str) -> str:
    """The new-visitor repair of a log stream; one folder of logs per micro-batch."""
    where = fresh_dir(logs.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        visits.repaired(batch).write.mode("overwrite").parquet(f"{where}/out/{batch_id}")
        batch.unpersist()

    rows = visits.with_first_days(logs.select(F.struct("*").alias("row")))
    _run(rows.writeStream.outputMode("update").foreachBatch(write), where, inputs)
    return f"{where}/out"


def _written(spark: SparkSession, where: str) -> DataFrame:
    """What a job has written, whole."""
    return spark.read.option("recursiveFileLookup", "true").parquet(where)


def _topic(like: DataFrame, where: str) -> DataFrame:
    """What a job before has written, as a stream."""
    return like.sparkSession.readStream.schema(like.schema).option("recursiveFileLookup", "true").parquet(where)


def _ordered_topic(like: DataFrame, where: str, time: str, slices: int) -> Callable[[], DataFrame]:
    """The same, to be read as streams in the order of ``time`` if it is more than a slice:
    a join hands its rows out as they meet, later than their own time."""
    if slices == 1:
        return lambda: _topic(like, where)
    rows = like.sparkSession.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(where)
    return _ordered(rows, time, "topic-in-order", slices)


def stream_is_new_repair(spark, sf):
    logs = _logs(spark, sf)
    where = run_repair(logs, "is-new", *_files(sf, "events"))
    fixed = spark.read.schema(logs.schema).option("recursiveFileLookup", "true").parquet(where)
    return fixed.select("common.mid", "ts", "common.is_new")


def stream_unique_visitor(spark, sf):
    rows = visits.unique_visitors(_pages(spark, sf))
    return drain(rows.select("common.mid", day_key(from_millis("ts")).alias("day"), "ts", "page.page_id"), "uv",
                 *_files(sf, "events"), run=run_update)


def stream_late_rows(spark, sf):
    """Every tenth event of the first half of the month comes with the second half; those
    whose hour the watermark, a day behind, has passed are counted by hour."""
    where = fresh_dir(spark, "late-rows")
    early, rest = _parts(spark, sf, CONFIG_CUT)
    held = F.get_json_object("props", "$.k").cast("int") % 10 == 0

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        late.late_rows(batch, "ts", "1 hour").write.mode("overwrite").parquet(f"{where}/late/{batch_id}")
        batch.unpersist()

    for i, part in enumerate((early.where(~held), rest.unionByName(early.where(held)))):
        part.coalesce(1).write.parquet(f"{where}/events/{i}")
        rows = _topic(part, f"{where}/events").withColumn("ts", F.col("ts").cast("timestamp"))
        opened = late.with_open_windows(rows, "ts", "1 hour", "1 day")
        _run(opened.writeStream.outputMode("update").foreachBatch(write), where, _files(sf, "events"))
    kept = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/late")
    return kept.groupBy(to_text("missed").alias("stt")).agg(F.count("*").alias("late_ct"))


def stream_user_jump(spark, sf):
    rows = shared.bounces(_pages(spark, sf), HOURLY.bounce_timeout_s, watermark="0 seconds")
    return drain(rows.select("common.mid", "ts", "page.page_id"), "jump", *_files(sf, "events"))


def stream_order_join(spark, sf):
    heads, details, n = _facts(spark, sf)
    picked = lambda lines: lines.select(
        "detail_id", "order_id", "sku_id", "sku_num", "user_id", to_text("create_time").alias("create_time"),
        to_text("detail_ts").alias("detail_time"))
    if n > 1:
        return _written(spark, _joined(heads, details, "order-join", picked))
    return drain(picked(_order_lines(heads(), details())), "order-join", *_files(sf, "orders", "lineitem"))


def stream_visitor_stats(spark, sf):
    """Repaired logs; the union of their pages with the topics of the two visit jobs."""
    logs = _logs(spark, sf)
    pages = routing.page_logs(_topic(logs, run_repair(logs, "page-topic", *_files(sf, "events"))))
    uniques = run_update(visits.unique_visitors(pages), "uv-topic", *_files(sf, "events"))
    jumps = run_append(shared.bounces(pages, HOURLY.bounce_timeout_s, watermark="0 seconds"), "jump-topic",
                       *_files(sf, "events"))
    rows = stats.visitor_rows(pages, _topic(pages, uniques), _topic(pages, jumps))
    return drain(stats.visitor_stats(rows, "1 hour", DELAY), "visitor-stats", *_files(sf, "events"))


def _order_lines(heads, details) -> DataFrame:
    return orders.order_lines(td.order_info(heads), td.order_detail(details), YEAR_S, YEAR_S, watermark=DELAY)


def _joined(heads, details, name: str, finish: Callable[[DataFrame], DataFrame]) -> str:
    """The order join of large tables: heads and lines wait for each other in files.  The
    folder of what ``finish`` makes of its rows."""
    join = lambda h, d: orders.order_lines(td.order_info(h), td.order_detail(d), YEAR_S, YEAR_S)
    return run_waiting({"heads": Input(heads(), "o_orderdate", YEAR_S), "lines": Input(details(), "l_shipdate", YEAR_S)}, name,
                        lambda waiting, batch, batch_id: finish(waiting.joined(batch, batch_id, join)))


def _wide_lines(lines: DataFrame, *columns: str) -> DataFrame:
    """Rows of the order_wide topic; what no reader needs, beyond ``columns``, is null and
    waits for no join."""
    return lines.select(*[c if c in columns else F.lit(None).cast(lines.schema[c].dataType).alias(c)
                          for c in schemas.column_names(schemas.ORDER_WIDE)])


def _order_wide(spark, sf, heads, details, slices: int, *columns: str,
                finish: Callable[[DataFrame], DataFrame] = lambda wide: wide) -> Callable[[], DataFrame]:
    """The order_wide topic that the join job fills, to be read as streams; ``finish`` is
    its last step on each micro-batch."""
    name, files = "order-wide-topic", _files(sf, "orders", "lineitem")
    if slices > 1:
        where = _joined(heads, details, name, lambda lines: finish(_wide_lines(lines, *columns)))
    else:
        where = run_batches(_wide_lines(_order_lines(heads(), details()), *columns), name, finish, *files)
    return _ordered_topic(_written(spark, where), where, "create_time", slices)


def _payments(spark, sf, wide: Callable[[], DataFrame], slices: int, name: str, *columns: str) -> str:
    """The payment job: callbacks, in an order of their own as they follow their orders, and
    the order_wide topic.  They wait for the minutes a callback may take; the order join,
    where rows wait for years, is run for the topic alone.  The folder of its rows."""
    if slices == 1:
        paid = orders.payment_wide(td.payment_info(td.table_stream(spark, sf, "orders")), wide(), watermark=DELAY)
        return run_append(paid.select(*columns), name, *_files(sf, "orders", "lineitem"))
    callbacks = _ordered(td.payment_info(td.table(spark, sf, "orders")), "callback_time", "payments-in-order", slices)()
    inputs = {"payments": Input(callbacks, "callback_time", settings.PAYMENT_JOIN_AFTER_S),
              "wide": Input(wide(), "create_time", settings.PAYMENT_JOIN_BEFORE_S)}
    return run_waiting(inputs, name, lambda waiting, batch, batch_id:
                       waiting.joined(batch, batch_id, orders.payment_wide).select(*columns))


# Event time and record key of the inputs of product statistics.
PRODUCT_TIMES = {"pages": ("ts",), "favors": ("create_time",), "carts": ("create_time",),
                 "order_wide": ("create_time", "detail_id", "order_id"),
                 "payment_wide": ("callback_time", "payment_id", "detail_id"),
                 "refunds": ("create_time", "order_id", "sku_id"), "comments": ("create_time",)}


def _closed(inputs: dict[str, DataFrame], name: str, times: dict[str, tuple[str, ...]],
            count: Callable[[dict[str, DataFrame]], DataFrame]) -> str:
    """Daily statistics of large topics: rows wait in files until their day is over.  The
    folder of what ``count`` makes of the rows of whole days."""
    return run_waiting({i: Input(rows, times[i][0], DAY_S, times[i][1:], millis=times[i][0] == "ts") for i, rows in inputs.items()}, name,
                       lambda waiting, batch, batch_id: count(waiting.closed(batch, batch_id, "1 day")))


def stream_payment_wide(spark, sf):
    heads, details, n = _facts(spark, sf)
    wide = _order_wide(spark, sf, heads, details, n, "order_id", "user_id", "sku_id", "sku_num", "province_id",
                       "total_amount", "split_total_amount", "create_time")
    return _plain(_written(spark, _payments(
        spark, sf, wide, n, "payment-wide", "payment_id", "subject", "payment_type", "payment_create_time", "callback_time",
        "order_create_time", "order_id", "user_id", "sku_id", "sku_num", "province_id", "total_amount", "split_total_amount")))


def stream_product_stats(spark, sf):
    """Seven inputs, each with a watermark of its own: pages, favourites and cart
    additions of the event stream (moved to the years of the orders), ordered and
    paid lines of the two join jobs' topics, refunds and comments."""
    shift = F.make_dt_interval(days=F.lit(EVENT_SHIFT_DAYS))
    heads, details, n = _facts(spark, sf, "l_returnflag", "l_linestatus")
    events = _replayed(spark, sf, "events", "ts", n)().withColumn("ts", F.col("ts") - shift)
    wide = _order_wide(spark, sf, heads, details, n, "detail_id", "order_id", "sku_id", "sku_num", "split_total_amount",
                       "create_time")
    paid = _payments(spark, sf, wide, n, "payment-wide-topic", "payment_id", "detail_id", "order_id", "sku_id",
                     "split_total_amount", "callback_time")
    paid_topic = _ordered_topic(_written(spark, paid), paid, "callback_time", n)
    inputs = {
        "pages": routing.page_logs(td.raw_logs(events)), "favors": td.sku_events(events, "click"),
        "carts": td.sku_events(events, "purchase"),
        "order_wide": wide().select("detail_id", "order_id", "sku_id", "sku_num", "split_total_amount", "create_time"),
        "payment_wide": paid_topic(), "refunds": td.refunds(details()), "comments": td.comments(details())}
    if n > 1:
        return _plain(_written(spark, _closed(inputs, "product-stats", PRODUCT_TIMES, lambda rows: stats.product_stats(
            stats.product_rows(**rows), "1 day"))))
    return _plain(drain(stats.product_stats(stats.product_rows(**inputs, watermark=DELAY), "1 day"), "product-stats",
                        *_files(sf, "events", "orders", "lineitem")))


def stream_province_stats(spark, sf):
    """Daily sums by province over the order_wide topic, which the join job fills and
    gives the names as of its micro-batch."""
    heads, details, n = _facts(spark, sf)
    provinces = td.dims(spark, sf)["province"]
    topic = _order_wide(spark, sf, heads, details, n, "detail_id", "order_id", "province_id", "split_total_amount", "create_time",
                        finish=lambda wide: enrich.add_province(wide, provinces))()
    if n > 1:
        return _plain(_written(spark, _closed({"order_wide": topic}, "province-stats", {"order_wide": ("create_time", "detail_id")},
                                              lambda rows: stats.province_stats(rows["order_wide"], "1 day"))))
    return _plain(drain(stats.province_stats(topic, "1 day", DELAY, replayed=True), "province-stats", *_files(sf, "orders")))


def _parts(spark, sf, cut: str) -> list[DataFrame]:
    events = td.table(spark, sf, "events")
    return [events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)]


def _halves(spark, sf, name: str, at: str, cut: str) -> tuple[DataFrame, DataFrame]:
    rows = td.table(spark, sf, name)
    return rows.where(F.col(at) < cut), rows.where(F.col(at) >= cut)


def stream_order_wide_dims(spark, sf):
    """Orders and lines before ``CUT``, then those after it; in between all provinces
    with an even key get a new name, and the users lose their gender."""
    where = fresh_dir(spark, "order-wide-dims")
    site = jobs.Site(FileBus(f"{where}/bus"), f"{where}/checkpoints", f"{where}/dims", f"{where}/tables",
                     trigger={"availableNow": True}, order_before_s=YEAR_S, order_after_s=YEAR_S,
                     waits_in_files=_join_slices(spark, sf) > 1)
    for short, dim in td.dims(spark, sf).items():
        columns = list(jobs.DIMENSIONS[short][1])
        table = site.dim_table(jobs.DIMENSIONS[short][0], columns, ["id"])
        table.create(spark)
        table.upsert(_changed(dim, columns), "seq", 1)
    heads = [td.order_info(h) for h in _halves(spark, sf, "orders", "o_orderdate", CUT)]
    lines = [td.order_detail(h) for h in _halves(spark, sf, "lineitem", "l_shipdate", CUT)]
    for i, (head, line) in enumerate(zip(heads, lines)):
        if i:
            renamed = td.dims(spark, sf)["province"].where("id % 2 = 0").select("id", F.concat("name", F.lit(" renamed")).alias("name"))
            site.dim_table(settings.DIM_PROVINCE, list(jobs.DIMENSIONS["province"][1]), ["id"]).upsert(
                _changed(renamed, ["name", "area_code", "iso_code", "iso_3166_2", "id"]), "seq", 2)
            nobody = td.dims(spark, sf)["user"].select("id", F.lit(None).cast("string").alias("gender"))
            site.dim_table(settings.DIM_USER, list(jobs.DIMENSIONS["user"][1]), ["id"]).upsert(
                _changed(nobody, ["id", "gender", "birthday"]), "seq", 2)
        records = [_as_topic(head, settings.FACT_ORDER_INFO), _as_topic(line, settings.FACT_ORDER_DETAIL)]
        site.bus.write_batch(records[0].unionByName(records[1]), "base_db", i)
        with state_partitions_for(spark, _files(sf, "orders", "lineitem")):
            jobs.order_wide(spark, site).awaitTermination()
    rows = parse.parse_record(site.bus.read_batch(spark, "order_wide", settings.DWM_ORDER_WIDE), schemas.ORDER_WIDE)
    return _plain(rows.select("detail_id", "order_id", "user_gender", "province_name", "sku_name", "spu_name", "category3_name",
                              "tm_name", "split_total_amount"))


def _changed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Dimension rows as changes; the columns they lack are absent."""
    have = [c for c in columns if c in rows.columns]
    return rows.select(F.lit(1).alias("seq"), F.array(*[F.lit(c) for c in have]).alias("present"),
                       *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in columns])


def _as_topic(rows: DataFrame, topic: str) -> DataFrame:
    """Records as a fact topic has them: times as text."""
    times = {f.name: to_text(f.name) for f in rows.schema if f.dataType.typeName() == "timestamp"}
    return to_messages(rows.withColumns(times), topic)


def _config_text(spark, rows: list[tuple], op: str, at: int) -> list[str]:
    image = [dict(zip(schemas.column_names(schemas.TABLE_PROCESS), row)) for row in rows]
    return [json.dumps({"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row,
                        "source": {"db": "conf", "table": "table_process"}, "ts_ms": at}) for row in image]


def stream_cdc_route(spark, sf):
    """Change records before and after ``CONFIG_CUT``; in between the configuration, whose
    snapshot came first, gets a changed, a new and a deleted row."""
    where = fresh_dir(spark, "cdc-route")
    config = [_config_text(spark, td.ROUTING, "r", 1),
              _config_text(spark, CHANGED_ROUTES, "u", 2) + _config_text(spark, GONE_ROUTES, "d", 2)]
    parts = _parts(spark, sf, CONFIG_CUT)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        found = routing.route(routing.well_formed(batch.where("row IS NOT NULL").select("row.*")),
                              batch.where("route IS NOT NULL").select("route.*"))
        found.write.mode("overwrite").parquet(f"{where}/out/{batch_id}")
        batch.unpersist()

    for i, part in enumerate(parts):
        rows = td.change_records(part)
        rows.write.parquet(f"{where}/records/{i}")
        spark.createDataFrame([(c,) for c in config[i]], "value string").write.text(f"{where}/config/{i}")
        feed = spark.readStream.option("recursiveFileLookup", "true").text(f"{where}/config")
        tagged = with_routes(_topic(rows, f"{where}/records").select(F.struct("*").alias("row")), changes.normalise_envelopes(feed))
        _run(tagged.writeStream.outputMode("update").foreachBatch(write), where, _files(sf, "events"))
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")
    return out.select("seq", "table", "type", "sink_type", "sink_table", *[F.col("data")[c].alias(c) for c in ("id", "name", "value")],
                      F.size("data").alias("n_columns"))


def stream_replayed_orders(spark, sf):
    """Province sums over an order_wide topic whose first half is delivered twice: once
    before and once after a consumer has read it."""
    where = fresh_dir(spark, "replayed-orders")
    n, at_once = _slices(spark, *_files(sf, "orders", "lineitem")), spark.sparkContext.defaultParallelism
    bus = FileBus(f"{where}/bus", max_files_per_trigger=at_once if n > 1 else None)
    lines = orders.order_lines(td.order_info(td.table(spark, sf, "orders")), td.order_detail(td.table(spark, sf, "lineitem")),
                               YEAR_S, YEAR_S).drop("order_ts", "detail_ts")
    lines = materialize(lines, "order-wide-lines")   # delivered three times, joined once
    late = F.col("create_time") >= CUT
    for deliveries in ({0: ~late}, {1: ~late, 2: late}):
        for batch_id, rows in deliveries.items():
            part = lines.where(rows) if n == 1 else in_time_order(lines.where(rows), "create_time", n * at_once)
            bus.write_batch(_as_topic(part, settings.DWM_ORDER_WIDE), "order_wide", batch_id)
            folder = f"{bus.root}/order_wide/topic={settings.DWM_ORDER_WIDE}/batch_id={batch_id}"
            if n > 1 and not keep_order(spark, folder):
                bus = FileBus(bus.root)
        topic = parse.parse_record(bus.read(spark, "order_wide", settings.DWM_ORDER_WIDE), schemas.ORDER_WIDE)
        sums = stats.province_stats(topic, "1 day", DELAY, replayed=True)
        _run(sums.writeStream.format("parquet").option("path", f"{where}/out"), where, _files(sf, "orders", "lineitem"), n)
    out = spark.read.schema(sums.schema).parquet(f"{where}/out")
    return _plain(out.select("stt", "edt", "province_id", "order_amount", "order_count"))


def stream_keyword_stats(spark, sf):
    n = _slices(spark, *_files(sf, "documents"))
    pages = routing.page_logs(td.search_logs(_replayed(spark, sf, "documents", "doc_id", n)()))
    words = stats.keywords(stats.searches(pages, DELAY))
    return drain(stats.keyword_stats(words, "1 hour"), "keyword-stats", *_files(sf, "documents"), slices=n)


def stream_keyword_stats_sql(spark, sf):
    """The keyword job in SQL over a topic of page logs with a computed watermark."""
    n, at_once = _slices(spark, *_files(sf, "events", "documents")), spark.sparkContext.defaultParallelism
    bus = FileBus(fresh_dir(spark, "sql-bus"))
    pages = routing.page_logs(td.raw_logs(td.table(spark, sf, "events")))
    both = pages.unionByName(td.search_logs(td.table(spark, sf, "documents")))
    folder = f"{bus.root}/{INTAKE}/topic={settings.DWD_PAGE}"
    size = F.length("page.item") / 64   # pages of documents are long, and lie in other hours than the many short ones
    parse.serialise(both if n == 1 else in_time_order(both, "ts", n * at_once, size)).write.text(folder)
    if n > 1 and keep_order(spark, folder):
        bus = FileBus(bus.root, max_files_per_trigger=at_once)
    topic_view(spark, bus, INTAKE, settings.DWD_PAGE, "martflow_page_topic",
               "page MAP<STRING, STRING>, ts BIGINT", "timestamp_millis(ts)", DELAY)
    register_word_table_function(spark, "ik_analyze")
    # The condition names the event time: the watermark then follows all pages.
    return drain(spark.sql("""
        WITH full_word_view AS (
          SELECT page['item'] AS full_word, rowtime FROM martflow_page_topic
          WHERE CASE WHEN page['page_id'] = 'good_list' AND page['item'] IS NOT NULL THEN rowtime END IS NOT NULL),
        keyword_view AS (
          SELECT t.word AS keyword, rowtime FROM full_word_view, LATERAL ik_analyze(full_word) t)
        SELECT keyword, count(*) AS ct, 'SEARCH' AS source,
          date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt
        FROM keyword_view GROUP BY window(rowtime, '1 hour'), keyword"""), "keyword-sql", *_files(sf, "documents"), slices=n)


def stream_province_stats_sql(spark, sf):
    """The province job in SQL over the order_wide topic."""
    bus = FileBus(fresh_dir(spark, "sql-bus"))
    lines = orders.order_lines(td.order_info(td.table(spark, sf, "orders")), td.order_detail(td.table(spark, sf, "lineitem")),
                               YEAR_S, YEAR_S).drop("order_ts", "detail_ts")
    wide = enrich.add_province(lines, td.dims(spark, sf)["province"])
    bus.write_batch(_as_topic(wide, settings.DWM_ORDER_WIDE), "order_wide", 0)
    topic_view(spark, bus, "order_wide", settings.DWM_ORDER_WIDE, "martflow_order_wide_topic", schemas.ORDER_WIDE,
               "to_timestamp(create_time, 'yyyy-MM-dd HH:mm:ss')", DELAY)
    return _plain(drain(spark.sql("""
        WITH per_order AS (
          SELECT window, province_id, province_name, province_area_code AS area_code, province_iso_code AS iso_code,
            province_3166_2_code AS iso_3166_2, order_id, sum(split_total_amount) AS amount
          FROM martflow_order_wide_topic
          GROUP BY window(rowtime, '1 day'), province_id, province_name, area_code, iso_code, iso_3166_2, order_id)
        SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt,
          province_id, province_name, area_code, iso_code, iso_3166_2, sum(amount) AS order_amount, count(order_id) AS order_count
        FROM per_order GROUP BY window, province_id, province_name, area_code, iso_code, iso_3166_2"""),
        "province-sql", *_files(sf, "orders", "lineitem")))


STREAMS = {f.__name__: f for f in (
    stream_is_new_repair, stream_unique_visitor, stream_user_jump, stream_order_join, stream_payment_wide,
    stream_visitor_stats, stream_product_stats, stream_province_stats, stream_keyword_stats,
    stream_order_wide_dims, stream_replayed_orders, stream_cdc_route, stream_keyword_stats_sql, stream_province_stats_sql,
    stream_late_rows,
)}
