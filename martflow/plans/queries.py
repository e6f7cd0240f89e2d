"""The query catalogue over the given test tables.

Each entry takes ``(spark, sf_dir)`` and reads whole tables.  The test data is
sparse in time, so windows and join bounds are wider than the live defaults.
Amounts leave as doubles, window bounds as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martflow import schemas, settings
from martflow.functions import segment
from martflow.functions.text import register_word_table_function, words
from martflow.functions.times import age_in_years, day_key, from_millis, from_text, to_text
from martflow.operators import enrich, orders, parse, routing, sketches, stats, visits
from martflow.plans import dashboard, warehouse
from martflow.session import fresh_dir, materialize
from martflow.sinks import dims as dim_sink
from martflow.sinks import stats as stats_sink
from martflow.sources import changes, tables, testdata as td

YEAR_S = 365 * 86400
HOURLY = warehouse.Spans(window="1 hour", bounce_timeout_s=4 * 3600)
DAILY = warehouse.Spans(window="1 day", order_before_s=YEAR_S, order_after_s=YEAR_S)
AS_OF = "2024-06-30"
VISIT_DAY = 20240103
SALES_DAY = 19980115
WORD_DAY = 20240101

Query = Callable[[SparkSession, str], DataFrame]


# --- inputs ------------------------------------------------------------------


def _events(spark: SparkSession, sf: str, day: int | None = None, history: bool = False) -> DataFrame:
    """Events; with ``day`` those of that day and the next, by the raw column so that
    the scan can skip the others, with ``history`` also all before."""
    events = td.table(spark, sf, "events")
    if day is None:
        return events
    kind = events.schema["ts"].dataType.simpleString()
    start = F.lit(dashboard.as_date(day))
    events = events.filter(F.col("ts") < F.date_add(start, 2).cast(kind))
    return events if history else events.filter(F.col("ts") >= start.cast(kind))


def _logs(spark: SparkSession, sf: str, day: int | None = None, history: bool = False) -> DataFrame:
    return td.raw_logs(_events(spark, sf, day, history))


def _pages(spark: SparkSession, sf: str, day: int | None = None) -> DataFrame:
    return routing.page_logs(_logs(spark, sf, day))


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return td.order_info(td.table(spark, sf, "orders")), td.order_detail(td.table(spark, sf, "lineitem"))


def _search_pages(spark: SparkSession, sf: str, day: int | None = None) -> DataFrame:
    return _pages(spark, sf, day).unionByName(td.search_logs(td.table(spark, sf, "documents")))


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


_PLAIN = {"decimal": "CAST({0} AS DOUBLE) AS {0}", "timestamp": "date_format({0}, 'yyyy-MM-dd HH:mm:ss') AS {0}"}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times as text, which both engines print alike."""
    return df.selectExpr(*[_PLAIN.get(f.dataType.typeName(), "{0}").format(f.name) for f in df.schema])


# --- logs ----------------------------------------------------------------------


def _raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw log text; every message of device 13 is cut off in the middle."""
    logs = td.raw_logs(td.table(spark, sf, "events"))
    text = F.to_json(F.struct("*"))
    return (logs.select(text.alias("value"))
            .withColumn("value", F.when(F.col("value").contains('"mid":"mid_13"'), '{"common":{"mid":')
                        .otherwise(F.col("value"))))


def log_parse(spark, sf):
    return _parsed(_raw_messages(spark, sf))


def log_parse_coerced(spark, sf):
    """The same logs with durations as text and times with a fraction."""
    value = F.regexp_replace("value", r'"during_time":(\d+)', r'"during_time":"$1"')
    return _parsed(_raw_messages(spark, sf).withColumn("value", F.regexp_replace(value, r'"ts":(\d+)', r'"ts":$1.0')))


def _parsed(messages: DataFrame) -> DataFrame:
    logs = parse.parse(messages, schemas.RAW_LOG)
    return logs.select(
        "common.mid", "common.is_new", "common.vc", "common.ch", "common.ar",
        F.size(F.coalesce("start", F.create_map().cast("map<string,string>"))).alias("start_size"),
        "page.page_id", "page.last_page_id", "page.item", "page.during_time",
        F.coalesce(F.size("displays"), F.lit(0)).alias("n_displays"), "ts")


def log_quarantine(spark, sf):
    return parse.malformed(_raw_messages(spark, sf), schemas.RAW_LOG).groupBy("value").agg(F.count("*").alias("n"))


def log_split_counts(spark, sf):
    logs = _logs(spark, sf)
    parts = {"start": routing.start_logs(logs).select("common.vc"),
             "page": routing.page_logs(logs).select("common.vc"),
             "display": routing.page_logs(logs).select(F.explode("displays"), "common.vc").select("vc")}
    union = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("route"), "vc")
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy("route", "vc").agg(F.count("*").alias("n"))


def display_explode(spark, sf):
    return routing.display_logs(_logs(spark, sf))


def is_new_repair(spark, sf):
    return visits.repair_is_new(_logs(spark, sf)).select("common.mid", "ts", "common.is_new")


def unique_visitor(spark, sf):
    return visits.unique_visitors(_pages(spark, sf)).select(
        "common.mid", day_key(from_millis("ts")).alias("day"), "ts", "page.page_id")


def user_jump(spark, sf):
    return visits.bounces(_pages(spark, sf), HOURLY.bounce_timeout_s).select("common.mid", "ts", "page.page_id")


# --- change records ----------------------------------------------------------


def _changes(spark, sf) -> DataFrame:
    return td.change_records(td.table(spark, sf, "events"))


def _data(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.col("data")["id"].alias("id"), F.col("data")["name"].alias("name"),
                     F.col("data")["value"].alias("value"), F.size("data").alias("n_columns"))


def cdc_filter(spark, sf):
    return _data(routing.well_formed(_changes(spark, sf)), "seq", "table", "type")


def cdc_envelope(spark, sf):
    envelopes = td.envelopes(td.table(spark, sf, "events"))
    return _data(changes.normalise_envelopes(envelopes, keep=("event_id",)), "event_id", "db", "table", "type")


def cdc_whitelist(spark, sf):
    cut = _changes(spark, sf).withColumn("data", routing.keep_columns("data", F.lit("id,name")))
    return _data(cut, "seq")


def cdc_route(spark, sf):
    routed = routing.route(routing.well_formed(_changes(spark, sf)), td.routing(spark))
    return _data(routed, "seq", "table", "type", "sink_type", "sink_table")


def cdc_sinks(spark, sf):
    """Facts and dimension changes, counted per sink."""
    routed = routing.route(routing.well_formed(_changes(spark, sf)), td.routing(spark))
    both = (routing.facts(routed).select(F.lit("fact").alias("side"), "sink_table")
            .unionByName(routing.dimension_changes(routed).select(F.lit("dim").alias("side"), "sink_table")))
    return both.groupBy("side", "sink_table").agg(F.count("*").alias("n"))


def cdc_unrouted(spark, sf):
    return routing.unrouted(routing.well_formed(_changes(spark, sf)), td.routing(spark)).select("seq", "table", "type")


def cdc_config_latest(spark, sf):
    """A config feed made of the events: the last row per (table, operation),
    gone if that row is a delete."""
    k = F.get_json_object("props", "$.k").cast("int")
    row = F.struct(F.col("event_type").alias("source_table"), (F.col("user_id") % 7).cast("string").alias("operate_type"),
                   F.lit("kafka").alias("sink_type"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("sink_table"),
                   F.lit("id,name").alias("sink_columns"))
    op = F.element_at(F.array(*[F.lit(o) for o in "crud"]), k % 4 + 1)
    feed = td.table(spark, sf, "events").select(F.to_json(F.struct(
        op.alias("op"), F.when(k % 4 >= 2, row).alias("before"), F.when(k % 4 != 3, row).alias("after"),
        F.struct(F.lit("mall").alias("db"), F.lit("table_process").alias("table")).alias("source"),
        F.col("event_id").alias("ts_ms"))).alias("value"))
    return changes.routes(changes.normalise_envelopes(feed)).select(
        "source_table", "operate_type", "sink_type", "sink_table", "sink_columns")


_DIM = ["id", "name", "value"]


def _dim_changes(spark, sf, *keep):
    """Updates come without a name; elsewhere a name may be set to null."""
    listed = F.when(F.col("type") == "update", "id,value").otherwise("id,name,value")
    rows = routing.well_formed(_changes(spark, sf)).withColumn("data", routing.keep_columns("data", listed))
    return routing.as_columns(rows, _DIM, keep=keep)


def dim_upsert_latest(spark, sf):
    base = td.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("value"))
    rows = _dim_changes(spark, sf, "seq")
    return dim_sink.merge(base, dim_sink.last_values(rows, ["id"], _DIM, "seq"), ["id"], _DIM)


def dim_sink_snapshots(spark, sf):
    """Create the table, upsert two feeds as two versions, merge, read it."""
    rows = _dim_changes(spark, sf, "seq", "table")
    dim = dim_sink.DimTable(fresh_dir(spark, "dim-user-info"), tuple(_DIM), ("id",))
    dim.create(spark)
    dim.upsert(rows.filter(F.col("table") == "user_info"), "seq", version=1)
    dim.upsert(rows.filter(F.col("table") == "sku_info"), "seq", version=2)
    dim.compact(spark, 1)
    return dim.read(spark)


# --- orders and payments -------------------------------------------------------


def order_create_parts(spark, sf):
    return orders.with_create_parts(_orders(spark, sf)[0]).select(
        "id", "create_date", "create_hour", "create_ts")


def time_functions(spark, sf):
    """Text to times and back: epoch milliseconds, day key, window labels."""
    text = F.date_format("o_orderdate", settings.TIMESTAMP_FORMAT)
    rows = td.table(spark, sf, "orders").select("o_orderkey", text.alias("create_time"))
    rows = rows.withColumn("t", from_text("create_time"))
    w = F.window("t", "10 seconds")
    return rows.select(
        "o_orderkey", "create_time", F.unix_millis("t").alias("ms"),
        to_text(from_millis(F.unix_millis("t"))).alias("again"), day_key("t").alias("day"),
        to_text(w["start"]).alias("stt"), to_text(w["end"]).alias("edt"))


_LINE = ["detail_id", "order_id", "sku_id", "order_price", "sku_num", "split_total_amount", "province_id",
         "order_status", "user_id", "total_amount", "feight_fee", "create_time", "create_date", "create_hour"]


def _order_lines(spark, sf) -> DataFrame:
    return warehouse.order_lines(*_orders(spark, sf), DAILY)


def order_wide_join(spark, sf):
    return plain(_order_lines(spark, sf).select(*_LINE, F.col("detail_ts").alias("detail_time")))


_USER = ["user_gender", "user_age"]
_PROVINCE = ["province_name", "province_area_code", "province_iso_code", "province_3166_2_code"]
_PRODUCT = ["sku_name", "spu_id", "spu_name", "category3_id", "category3_name", "tm_id", "tm_name"]


def order_wide_user(spark, sf):
    users = td.dims(spark, sf)["user"]
    return plain(enrich.add_user(_order_lines(spark, sf), users, _as_of()).select(*_LINE, *_USER))


def order_wide_province(spark, sf):
    provinces = td.dims(spark, sf)["province"]
    return plain(enrich.add_province(_order_lines(spark, sf), provinces).select(*_LINE, *_PROVINCE))


def order_wide_full(spark, sf):
    wide = enrich.add_all(_order_lines(spark, sf), td.dims(spark, sf), _as_of())
    return plain(wide.select(*_LINE, *_USER, *_PROVINCE, *_PRODUCT))


def user_ages(spark, sf):
    return td.dims(spark, sf)["user"].select("id", "gender", age_in_years("birthday", _as_of()).alias("age"))


def dim_multi_key(spark, sf):
    """Lines looked up by (part, supplier) in the returns of that pair."""
    lines = td.table(spark, sf, "lineitem")
    returned = (lines.filter(F.col("l_returnflag") == "R").groupBy("l_partkey", "l_suppkey")
                .agg(F.count("*").alias("n"), F.max("l_quantity").alias("max_quantity")))
    found = enrich.lookup(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), returned,
                          {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"},
                          {"returns": "n", "max_returned": "max_quantity"})
    return found


def payment_wide(spark, sf):
    payments = td.payment_info(td.table(spark, sf, "orders"))
    wide = warehouse.payment_wide(payments, _order_lines(spark, sf), DAILY)
    return plain(wide.select(
        "payment_id", "subject", "payment_type", "payment_create_time", "callback_time", "order_create_time",
        "order_id", "user_id", "sku_id", "sku_num", "province_id", "total_amount", "split_total_amount"))


def coalesce_merge(spark, sf):
    """Orders with gaps, filled from a second copy of the same orders."""
    left = td.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("amount"))
    right = (td.table(spark, sf, "lineitem").groupBy("l_orderkey")
             .agg(F.sum(F.col("l_extendedprice").cast("decimal(16,2)")).cast("double").alias("amount"))
             .select(F.col("l_orderkey").alias("o_orderkey"), F.lit("unknown").alias("priority"), "amount"))
    return orders.first_non_null(left, right, ["o_orderkey"])


# --- statistics ----------------------------------------------------------------


def visitor_stats(spark, sf):
    return warehouse.visitor_stats(_logs(spark, sf), HOURLY)


def _product_stats(spark, sf, day=None) -> DataFrame:
    events = _events(spark, sf, day)
    lineitem, all_orders = (td.table(spark, sf, t) for t in ("lineitem", "orders"))
    return warehouse.product_stats(
        _pages(spark, sf, day), td.sku_events(events, "click"), td.sku_events(events, "purchase"),
        td.order_info(all_orders), td.order_detail(lineitem), td.payment_info(all_orders),
        td.refunds(lineitem), td.comments(lineitem), DAILY, day)


def product_stats(spark, sf):
    return plain(_product_stats(spark, sf))


def product_stats_dims(spark, sf):
    return plain(enrich.add_product(_product_stats(spark, sf), td.dims(spark, sf), price=True))


def _province_stats(spark, sf, day=None) -> DataFrame:
    return warehouse.province_stats(*_orders(spark, sf), td.dims(spark, sf)["province"], DAILY, day)


def province_stats(spark, sf):
    return plain(_province_stats(spark, sf))


def keyword_stats(spark, sf):
    return warehouse.keyword_stats(_search_pages(spark, sf), HOURLY)


def keyword_stats_sql(spark, sf):
    """Keyword statistics as SQL over views, with the table function."""
    register_word_table_function(spark, "ik_analyze")
    pages = _search_pages(spark, sf).select("common", "page", from_millis("ts").alias("rowtime"))
    pages.createOrReplaceTempView("martflow_page_view")
    return spark.sql("""
        WITH full_word_view AS (
          SELECT page['item'] AS full_word, rowtime FROM martflow_page_view
          WHERE page['page_id'] = 'good_list' AND page['item'] IS NOT NULL),
        keyword_view AS (
          SELECT t.word AS keyword, rowtime FROM full_word_view, LATERAL ik_analyze(full_word) t)
        SELECT keyword, count(*) AS ct, 'SEARCH' AS source,
          date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt
        FROM keyword_view GROUP BY window(rowtime, '1 hour'), keyword""")


def keyword_stats_dictionary(spark, sf):
    """Each line searches for its part's name, written without blanks; the names'
    words are the dictionary."""
    part = td.table(spark, sf, "part")
    dictionary = segment.load(part.select(F.explode(words("p_name")).alias("word")), "word")
    named = td.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    searches = named.select(F.regexp_replace("p_name", " ", "").alias("full_word"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return stats.keyword_stats(stats.keywords(searches, segment.dictionary_words(dictionary)), "1 day")


def customer_estimates(spark, sf):
    """Customers by month and by year from daily sketches, held against exact counts."""
    rows = _orders(spark, sf)[0].select("create_time", "user_id")
    daily = materialize(sketches.window_sketches(rows, "create_time", "1 day", [], "user_id"), "customer-sketches")
    union = None
    for span in ("month", "year"):
        start = F.date_trunc(span, "create_time").alias("start")
        exact = rows.select(start, "user_id").distinct().groupBy("start").agg(F.count("*").alias("customer_ct"))
        both = sketches.merged(daily, span, []).join(exact, "start")
        close = F.abs(F.col("distinct_ct") - F.col("customer_ct")) <= 0.02 * F.col("customer_ct")
        found = both.select(F.lit(span).alias("span"), to_text("start").alias("start"), "customer_ct", close.alias("close"))
        union = found if union is None else union.unionByName(found)
    return union


def word_counts(spark, sf):
    docs = td.table(spark, sf, "documents")
    return docs.select(F.explode(words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("ct"))


def udtf_tokens(spark, sf):
    """The same words through the SQL table function."""
    register_word_table_function(spark, "ik_analyze")
    td.table(spark, sf, "documents").createOrReplaceTempView("martflow_documents")
    return spark.sql("SELECT t.word, count(*) AS ct FROM martflow_documents, LATERAL ik_analyze(text) t GROUP BY t.word")


def stats_table(spark, sf):
    """Write visitor statistics in the table's shape, read one day back."""
    path = fresh_dir(spark, "visitor-stats")
    stats_sink.append_batch(visitor_stats(spark, sf), schemas.VISITOR_STATS, path)
    return tables.stats_table(spark, path, "2024-01-03").drop("ts", "dt")


# --- dashboard -------------------------------------------------------------------


def _sales(spark, sf) -> DataFrame:
    """The day's product statistics with names."""
    return enrich.add_product(_product_stats(spark, sf, SALES_DAY), td.dims(spark, sf))


def dash_spu(spark, sf):
    return plain(dashboard.top_spu(_sales(spark, sf), SALES_DAY))


def dash_category3(spark, sf):
    return plain(dashboard.top_category3(_sales(spark, sf), SALES_DAY))


def dash_tm(spark, sf):
    return plain(dashboard.top_trademark(_sales(spark, sf), SALES_DAY))


def dash_tm_series(spark, sf):
    row = dashboard.categories_and_series(dashboard.top_trademark(_sales(spark, sf), SALES_DAY), "tm_name", "order_amount")
    return row.select(F.array_join("categories", ",").alias("categories"),
                      F.array_join(F.col("series").cast("array<string>"), ",").alias("series"))


def dash_gmv(spark, sf):
    return plain(dashboard.gmv(_product_stats(spark, sf, SALES_DAY), SALES_DAY))


def dash_gmv_empty_day(spark, sf):
    return plain(dashboard.gmv(_product_stats(spark, sf, 20300101), 20300101))


def _visits(spark, sf) -> DataFrame:
    """The day's visitor statistics."""
    return warehouse.visitor_stats(_logs(spark, sf, VISIT_DAY, history=True), HOURLY, VISIT_DAY)


def dash_hour(spark, sf):
    return dashboard.visitors_by_hour(_visits(spark, sf), VISIT_DAY)


def dash_is_new(spark, sf):
    return plain(dashboard.new_versus_returning(_visits(spark, sf), VISIT_DAY))


def dash_novelty(spark, sf):
    return dashboard.visitors_by_novelty(_visits(spark, sf), VISIT_DAY)


def dash_map(spark, sf):
    report = dashboard.amount_by_province(_province_stats(spark, sf, SALES_DAY), SALES_DAY)
    return plain(dashboard.name_value(report, "province_name", "order_amount"))


def dash_keyword(spark, sf):
    words_of_day = warehouse.keyword_stats(_search_pages(spark, sf, WORD_DAY), HOURLY, WORD_DAY)
    return dashboard.name_value(dashboard.hot_keywords(words_of_day, WORD_DAY), "keyword", "ct")


def flagship(spark, sf):
    """Orders, lines and provinces: join, enrich, window, and sum by province."""
    return dash_map(spark, sf)


BATCH: dict[str, Query] = {f.__name__: f for f in (
    log_parse, log_parse_coerced, log_quarantine, log_split_counts, display_explode, is_new_repair, unique_visitor, user_jump,
    cdc_filter, cdc_envelope, cdc_whitelist, cdc_route, cdc_sinks, cdc_unrouted, cdc_config_latest,
    dim_upsert_latest, dim_sink_snapshots, time_functions, order_create_parts, order_wide_join, order_wide_user,
    order_wide_province, order_wide_full, user_ages, dim_multi_key, payment_wide, coalesce_merge,
    visitor_stats, product_stats, product_stats_dims, province_stats, keyword_stats, keyword_stats_sql,
    keyword_stats_dictionary, customer_estimates, word_counts, udtf_tokens,
    stats_table, dash_spu, dash_category3, dash_tm, dash_tm_series, dash_gmv, dash_gmv_empty_day, dash_hour,
    dash_is_new, dash_novelty, dash_map, dash_keyword,
)}
