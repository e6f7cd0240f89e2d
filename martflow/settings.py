"""Fixed values of the warehouse: durations, codes, topic names, weights."""

# --- durations in seconds (every operator takes them as parameters) ---------
STATS_WINDOW = "10 seconds"
WATERMARK_DELAY_S = 3
BOUNCE_TIMEOUT_S = 10
ORDER_JOIN_BEFORE_S = 5
ORDER_JOIN_AFTER_S = 5
PAYMENT_JOIN_BEFORE_S = 30 * 60
PAYMENT_JOIN_AFTER_S = 0
VISITOR_STATE_TTL_S = 24 * 60 * 60

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_FORMAT = "yyyyMMdd"

# --- fixed business codes ---------------------------------------------------
APPRAISE_GOOD = "1201"

# --- fixed keyword weights of the hot-word report; unknown sources weigh 0 --
KEYWORD_WEIGHTS = {"SEARCH": 10, "ORDER": 5, "CART": 2, "CLICK": 1}
KEYWORD_SEARCH = "SEARCH"

# --- fixed page and item names ----------------------------------------------
PAGE_GOOD_DETAIL = "good_detail"
PAGE_GOOD_LIST = "good_list"
ITEM_SKU = "sku_id"

# --- fixed routing names ----------------------------------------------------
SINK_FACT = "kafka"
SINK_DIM = "hbase"
DEFAULT_PK = "id"

# --- fixed topic names ------------------------------------------------------
ODS_LOG = "ods_base_log"
ODS_DB = "ods_base_db"
ODS_CONFIG = "ods_table_process"
DWD_PAGE = "dwd_page_log"
DWD_START = "dwd_start_log"
DWD_DISPLAY = "dwd_display_log"
UNROUTED = "unrouted_changes"
BAD_LOG = "quarantine_log"
BAD_CHANGE = "quarantine_changes"
DWM_UNIQUE_VISITOR = "dwm_unique_visitor"
DWM_USER_JUMP = "dwm_user_jump_detail"
DWM_ORDER_WIDE = "dwm_order_wide"
DWM_PAYMENT_WIDE = "dwm_payment_wide"
FACT_ORDER_INFO = "dwd_order_info"
FACT_ORDER_DETAIL = "dwd_order_detail"
FACT_PAYMENT = "dwd_payment_info"
FACT_FAVOR = "dwd_favor_info"
FACT_CART = "dwd_cart_info"
FACT_REFUND = "dwd_order_refund_info"
FACT_COMMENT = "dwd_comment_info"

DIM_USER = "dim_user_info"
DIM_PROVINCE = "dim_base_province"
DIM_SKU = "dim_sku_info"
DIM_SPU = "dim_spu_info"
DIM_CATEGORY3 = "dim_base_category3"
DIM_TRADEMARK = "dim_base_trademark"

TOP_N = 10
