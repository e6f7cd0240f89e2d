"""Record schemas, as DDL strings that ``from_json`` and readers accept."""

PAGE_LOG = """
    common STRUCT<mid: STRING, is_new: STRING, vc: STRING, ch: STRING, ar: STRING>,
    start STRUCT<entry: STRING, loading_time: BIGINT>,
    page STRUCT<page_id: STRING, last_page_id: STRING, item: STRING, during_time: BIGINT>,
    displays ARRAY<STRUCT<item: STRING, item_type: STRING>>,
    ts BIGINT
"""

# The raw log keeps ``start`` open: its inner fields are never read, only
# whether it has any.
RAW_LOG = PAGE_LOG.replace("STRUCT<entry: STRING, loading_time: BIGINT>", "MAP<STRING, STRING>")

DISPLAY_LOG = "item STRING, item_type STRING, page_id STRING, ts STRING"

CHANGE_RECORD = "`table` STRING, type STRING, data MAP<STRING, STRING>"

DEBEZIUM = """
    op STRING,
    before MAP<STRING, STRING>,
    after MAP<STRING, STRING>,
    source STRUCT<db: STRING, `table`: STRING>,
    ts_ms BIGINT
"""

TABLE_PROCESS = """
    source_table STRING, operate_type STRING, sink_type STRING,
    sink_table STRING, sink_columns STRING, sink_pk STRING, sink_extend STRING
"""

ORDER_INFO = """
    id BIGINT, province_id BIGINT, order_status STRING, user_id BIGINT,
    total_amount DECIMAL(16,2), activity_reduce_amount DECIMAL(16,2),
    coupon_reduce_amount DECIMAL(16,2), original_total_amount DECIMAL(16,2),
    feight_fee DECIMAL(16,2), expire_time STRING, create_time STRING, operate_time STRING
"""

ORDER_DETAIL = """
    id BIGINT, order_id BIGINT, sku_id BIGINT, order_price DECIMAL(16,2), sku_num BIGINT,
    sku_name STRING, create_time STRING, split_total_amount DECIMAL(16,2),
    split_activity_amount DECIMAL(16,2), split_coupon_amount DECIMAL(16,2)
"""

PAYMENT_INFO = """
    id BIGINT, order_id BIGINT, user_id BIGINT, total_amount DECIMAL(16,2),
    subject STRING, payment_type STRING, create_time STRING, callback_time STRING
"""

ORDER_WIDE = """
    detail_id BIGINT, order_id BIGINT, sku_id BIGINT, order_price DECIMAL(16,2),
    sku_num BIGINT, sku_name STRING, province_id BIGINT, order_status STRING,
    user_id BIGINT, total_amount DECIMAL(16,2), activity_reduce_amount DECIMAL(16,2),
    coupon_reduce_amount DECIMAL(16,2), original_total_amount DECIMAL(16,2),
    feight_fee DECIMAL(16,2), split_feight_fee DECIMAL(16,2),
    split_activity_amount DECIMAL(16,2), split_coupon_amount DECIMAL(16,2),
    split_total_amount DECIMAL(16,2), expire_time STRING, create_time STRING,
    operate_time STRING, create_date STRING, create_hour STRING,
    province_name STRING, province_area_code STRING, province_iso_code STRING,
    province_3166_2_code STRING, user_age INT, user_gender STRING, spu_id BIGINT,
    tm_id BIGINT, category3_id BIGINT, spu_name STRING, tm_name STRING,
    category3_name STRING
"""

PAYMENT_WIDE = """
    payment_id BIGINT, subject STRING, payment_type STRING, payment_create_time STRING,
    callback_time STRING, detail_id BIGINT, order_id BIGINT, sku_id BIGINT,
    order_price DECIMAL(16,2), sku_num BIGINT, sku_name STRING, province_id BIGINT,
    order_status STRING, user_id BIGINT, total_amount DECIMAL(16,2),
    activity_reduce_amount DECIMAL(16,2), coupon_reduce_amount DECIMAL(16,2),
    original_total_amount DECIMAL(16,2), feight_fee DECIMAL(16,2),
    split_feight_fee DECIMAL(16,2), split_activity_amount DECIMAL(16,2),
    split_coupon_amount DECIMAL(16,2), split_total_amount DECIMAL(16,2),
    order_create_time STRING, province_name STRING, province_area_code STRING,
    province_iso_code STRING, province_3166_2_code STRING, user_age INT,
    user_gender STRING, spu_id BIGINT, tm_id BIGINT, category3_id BIGINT,
    spu_name STRING, tm_name STRING, category3_name STRING
"""

SKU_EVENT = "sku_id BIGINT, create_time STRING"
REFUND = "sku_id BIGINT, order_id BIGINT, refund_amount DECIMAL(16,2), create_time STRING"
COMMENT = "sku_id BIGINT, appraise STRING, create_time STRING"


def column_names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string, in order."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names


# Column order of the four statistics tables; ``ts`` is the time of writing.
VISITOR_STATS = ["stt", "edt", "vc", "ch", "ar", "is_new",
                 "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum", "ts"]
PRODUCT_STATS = ["stt", "edt", "sku_id", "sku_name", "sku_price", "spu_id", "spu_name",
                 "tm_id", "tm_name", "category3_id", "category3_name", "display_ct",
                 "click_ct", "favor_ct", "cart_ct", "order_sku_num", "order_amount",
                 "order_ct", "payment_amount", "paid_order_ct", "refund_order_ct",
                 "refund_amount", "comment_ct", "good_comment_ct", "ts"]
PROVINCE_STATS = ["stt", "edt", "province_id", "province_name", "area_code", "iso_code",
                  "iso_3166_2", "order_amount", "order_count", "ts"]
KEYWORD_STATS = ["keyword", "ct", "source", "stt", "edt", "ts"]
