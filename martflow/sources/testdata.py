"""The warehouse's inputs, derived from the given test tables.

Every mapping is local to a row, so it adds no shuffle and works on batch and
streaming frames; SQL can repeat each of them.  README lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONEY = "decimal(16,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream.  The bracket makes the path a glob, which lets the
    file source take a single file as well as a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _by_event(mapping: dict[str, str | Column]) -> Column:
    out = F.lit(None).cast("string")
    for event, value in mapping.items():
        out = F.when(F.col("event_type") == event, value).otherwise(out)
    return out


def raw_logs(events: DataFrame) -> DataFrame:
    """Behaviour logs: a signup is a start log, other events are page views."""
    e = events.select("*", _k().alias("k"), F.col("ts").cast("timestamp").alias("t"))
    text = lambda prefix, n: F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))
    page_id = _by_event({
        "view": F.lit("good_detail"), "click": F.lit("good_list"), "purchase": F.lit("payment"),
        "error": F.when(F.col("k") % 10 == 9, "").otherwise("home")})
    last_page = (F.when(F.col("k") % 2 == 0, F.lit(None).cast("string"))
                 .when(F.col("k") % 10 == 1, "").otherwise("home"))
    item = _by_event({
        "view": F.col("k").cast("string"),
        "click": F.when(F.col("k") % 10 != 0, F.concat(F.lit("phone case "), F.col("k").cast("string")))})
    during = F.when(F.col("k") != 98, F.floor(F.col("value") * 1000).cast("bigint"))
    display = lambda i: F.struct(
        ((F.col("k") * 7 + i) % 200).cast("string").alias("item"),
        F.when(i % 2 == 0, "sku_id").otherwise("activity_id").alias("item_type"))
    displays = F.when(F.col("k") % 4 > 0, F.transform(F.sequence(F.lit(0), F.col("k") % 4 - 1), display))
    signup = F.col("event_type") == "signup"
    return e.select(
        F.struct(
            F.concat(F.lit("mid_"), F.col("user_id").cast("string")).alias("mid"),
            F.when(F.col("k") < 50, "1").otherwise("0").alias("is_new"),
            text("v", 3).alias("vc"), text("ch", 4).alias("ch"), text("ar", 5).alias("ar"),
        ).alias("common"),
        F.when(signup, F.struct(F.lit("icon").alias("entry"),
                                F.col("k").cast("bigint").alias("loading_time"))).alias("start"),
        F.when(~signup, F.struct(page_id.alias("page_id"), last_page.alias("last_page_id"),
                                 item.alias("item"), during.alias("during_time"))).alias("page"),
        displays.alias("displays"),
        F.unix_millis("t").alias("ts"),
    )


def search_logs(documents: DataFrame) -> DataFrame:
    """Each document, whole, as one search: one page view per minute from 2024."""
    ms = F.lit(1704067200000) + F.col("doc_id") * 60000
    none = F.lit(None).cast("string")
    return documents.select(
        F.struct(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("mid"),
                 F.lit("0").alias("is_new"), F.col("lang").alias("vc"), F.col("source").alias("ch"),
                 F.lit("ar0").alias("ar")).alias("common"),
        F.lit(None).cast("struct<entry:string,loading_time:bigint>").alias("start"),
        F.struct(F.lit("good_list").alias("page_id"), none.alias("last_page_id"),
                 F.col("text").alias("item"), F.col("n_chars").alias("during_time")).alias("page"),
        F.lit(None).cast("array<struct<item:string,item_type:string>>").alias("displays"),
        ms.alias("ts"),
    )


def order_info(orders: DataFrame) -> DataFrame:
    total = F.col("o_totalprice").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 26).alias("province_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").alias("user_id"),
        total.alias("total_amount"), zero.alias("activity_reduce_amount"),
        zero.alias("coupon_reduce_amount"), total.alias("original_total_amount"),
        F.lit(10).cast(MONEY).alias("feight_fee"),
        F.lit(None).cast("string").alias("expire_time"),
        F.col("o_orderdate").cast("timestamp").alias("create_time"),
        F.lit(None).cast("string").alias("operate_time"),
    )


def _line_amount() -> Column:
    price = F.col("l_extendedprice").cast(MONEY)
    return (price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)


def order_detail(lineitem: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    return lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_extendedprice").cast(MONEY).alias("order_price"),
        F.col("l_quantity").cast("bigint").alias("sku_num"),
        F.lit(None).cast("string").alias("sku_name"),
        F.col("l_shipdate").cast("timestamp").alias("create_time"),
        _line_amount().alias("split_total_amount"),
        zero.alias("split_activity_amount"), zero.alias("split_coupon_amount"),
    )


def payment_info(orders: DataFrame) -> DataFrame:
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 40).cast("int"))
    return orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("subject"),
        F.concat(F.lit("110"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("payment_type"),
        F.col("o_orderdate").cast("timestamp").alias("create_time"),
        (F.col("o_orderdate") + minutes).cast("timestamp").alias("callback_time"),
    )


def refunds(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("sku_id"), F.col("l_orderkey").alias("order_id"),
        _line_amount().alias("refund_amount"), F.col("l_shipdate").cast("timestamp").alias("create_time"))


def comments(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_partkey").alias("sku_id"),
        F.when(F.col("l_linestatus") == "F", "1201").otherwise("1202").alias("appraise"),
        F.col("l_shipdate").cast("timestamp").alias("create_time"))


def sku_events(events: DataFrame, event_type: str) -> DataFrame:
    """Favourites come from clicks, cart additions from purchases."""
    return events.filter(F.col("event_type") == event_type).select(
        _k().cast("bigint").alias("sku_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("create_time"))


def dim_user(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") % 2500 * 7).cast("int")).alias("birthday"))


def dim_province(nation: DataFrame) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    return nation.select(
        key.alias("id"), F.col("n_name").alias("name"), (key + 100).cast("string").alias("area_code"),
        F.concat(F.lit("ISO-"), key.cast("string")).alias("iso_code"),
        F.concat(F.lit("CN-"), key.cast("string")).alias("iso_3166_2"))


def _category3_id() -> Column:
    return (F.length("p_type") * 1000 + F.ascii("p_type")).cast("bigint")


def _tm_id() -> Column:
    return F.substring("p_brand", 7, 10).cast("bigint")


def dim_sku(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"),
        F.col("p_retailprice").cast(MONEY).alias("price"), F.col("p_size").cast("bigint").alias("spu_id"),
        _category3_id().alias("category3_id"), _tm_id().alias("tm_id"))


def dim_spu(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_size").cast("bigint").alias("id"),
                       F.concat(F.lit("spu "), F.col("p_size").cast("string")).alias("spu_name")).distinct()


def dim_category3(part: DataFrame) -> DataFrame:
    return part.select(_category3_id().alias("id"), F.col("p_type").alias("name")).distinct()


def dim_trademark(part: DataFrame) -> DataFrame:
    return part.select(_tm_id().alias("id"), F.col("p_brand").alias("tm_name")).distinct()


def dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part")
    return {
        "user": dim_user(table(spark, sf_dir, "customer")),
        "province": dim_province(table(spark, sf_dir, "nation")),
        "sku": dim_sku(part), "spu": dim_spu(part),
        "category3": dim_category3(part), "trademark": dim_trademark(part),
    }


def change_records(events: DataFrame) -> DataFrame:
    """Binlog records, some malformed; ``seq`` is the commit order."""
    e = events.select("*", _k().alias("k"))
    source = _by_event({
        "view": F.lit("sku_info"), "click": F.lit("spu_info"), "signup": F.lit("user_info"),
        "purchase": F.lit("order_info"),
        "error": F.when(F.col("k") % 10 == 0, "").otherwise("base_trademark")})
    operation = F.element_at(F.array(*[F.lit(t) for t in ("insert", "update", "delete", "bootstrap-insert")]),
                             F.col("k") % 4 + 1)
    name = F.when(F.col("k") % 3 != 0, F.concat(F.lit("n"), F.col("event_id").cast("string")))
    data = F.create_map(F.lit("id"), F.col("user_id").cast("string"), F.lit("name"), name,
                        F.lit("value"), F.col("k").cast("string"), F.lit("junk"), F.lit("x"))
    empty = F.create_map().cast("map<string,string>")
    return e.select(F.col("event_id").alias("seq"), source.alias("table"), operation.alias("type"),
                    F.when(F.col("k") % 7 == 0, empty).otherwise(data).alias("data"))


def envelopes(events: DataFrame) -> DataFrame:
    """The same events as Debezium envelope text."""
    e = events.select("*", _k().alias("k"))
    row = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("k").alias("value"))
    op = F.element_at(F.array(*[F.lit(o) for o in "crud"]), F.col("k") % 4 + 1)
    envelope = F.struct(
        op.alias("op"),
        F.when(F.col("k") % 4 >= 2, row).alias("before"),
        F.when(F.col("k") % 4 != 3, row).alias("after"),
        F.struct(F.lit("mall").alias("db"), F.col("event_type").alias("table")).alias("source"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return e.select("event_id", F.to_json(envelope).alias("value"))


# Fixed routing rows used with ``change_records``.
ROUTING = [
    ("sku_info", "insert", "hbase", "dim_sku_info", "id,name,value", "id", None),
    ("sku_info", "update", "hbase", "dim_sku_info", "id,value", "id", None),
    ("user_info", "insert", "hbase", "dim_user_info", "id,name", None, None),
    ("base_trademark", "insert", "hbase", "dim_base_trademark", "id,name", "id", ""),
    ("order_info", "insert", "kafka", "dwd_order_info", "id,value", "id", None),
    ("order_info", "update", "kafka", "dwd_order_info", "id,name,value", "id", None),
]


def routing(spark: SparkSession) -> DataFrame:
    from martflow.schemas import TABLE_PROCESS

    return spark.createDataFrame(ROUTING, TABLE_PROCESS)
