"""The query catalogue as SQL for DuckDB, over the same test tables."""

from __future__ import annotations

from martflow.plans.queries import AS_OF
from martflow.streaming.replay import CHANGED_ROUTES, CONFIG_CUT, CUT, EVENT_SHIFT_DAYS, GONE_ROUTES

# --- shared table expressions ------------------------------------------------

_K = "k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"

_LOGS = _K + """,
logs AS (
  SELECT 'mid_' || user_id AS mid, CASE WHEN k < 50 THEN '1' ELSE '0' END AS is_new,
    'v' || (user_id % 3) AS vc, 'ch' || (user_id % 4) AS ch, 'ar' || (user_id % 5) AS ar,
    event_type = 'signup' AS is_start,
    CASE event_type WHEN 'view' THEN 'good_detail' WHEN 'click' THEN 'good_list' WHEN 'purchase' THEN 'payment'
      WHEN 'error' THEN CASE WHEN k % 10 = 9 THEN '' ELSE 'home' END END AS page_id,
    CASE WHEN event_type = 'signup' OR k % 2 = 0 THEN NULL WHEN k % 10 = 1 THEN '' ELSE 'home' END AS last_page_id,
    CASE event_type WHEN 'view' THEN CAST(k AS VARCHAR)
      WHEN 'click' THEN CASE WHEN k % 10 <> 0 THEN 'phone case ' || k END END AS item,
    CASE WHEN event_type <> 'signup' AND k <> 98 THEN CAST(floor(value * 1000) AS BIGINT) END AS during_time,
    k, epoch_us(ts) // 1000 AS ts, strftime(ts, '%Y%m%d') AS day
  FROM k),
pages AS (SELECT * FROM logs WHERE NOT is_start)"""

_REPAIRED = _LOGS + """,
repaired AS (
  SELECT * REPLACE (CASE WHEN is_new = '1' AND day <> min(day) FILTER (WHERE is_new = '1') OVER (PARTITION BY mid)
    THEN '0' ELSE is_new END AS is_new) FROM logs),
repaired_pages AS (SELECT * FROM repaired WHERE NOT is_start)"""


def _uv(pages: str) -> str:
    return f"""(SELECT * FROM {pages} WHERE coalesce(last_page_id, '') = ''
      QUALIFY row_number() OVER (PARTITION BY mid, day ORDER BY ts, page_id) = 1)"""


def _uj(pages: str, timeout_ms: int = 4 * 3600 * 1000) -> str:
    return f"""(SELECT * EXCLUDE (next_ts) FROM
      (SELECT *, lead(ts) OVER (PARTITION BY mid ORDER BY ts) AS next_ts FROM {pages})
      WHERE coalesce(last_page_id, '') = '' AND (next_ts IS NULL OR next_ts - ts >= {timeout_ms}))"""


_DISPLAYS = """displays AS (
  SELECT CAST((k * 7 + i) % 200 AS VARCHAR) AS item, CASE WHEN i % 2 = 0 THEN 'sku_id' ELSE 'activity_id' END AS item_type,
    page_id, CAST(ts AS VARCHAR) AS ts, vc
  FROM (SELECT *, unnest(generate_series(0, k % 4 - 1)) AS i FROM pages WHERE k % 4 > 0))"""

_CHANGES = _K + """,
changes AS (
  SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'sku_info' WHEN 'click' THEN 'spu_info' WHEN 'signup' THEN 'user_info'
      WHEN 'purchase' THEN 'order_info' ELSE CASE WHEN k % 10 = 0 THEN '' ELSE 'base_trademark' END END AS "table",
    CASE k % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'bootstrap-insert' END AS type,
    CASE WHEN k % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS id,
    CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN 'n' || event_id END AS name,
    CASE WHEN k % 7 <> 0 THEN CAST(k AS VARCHAR) END AS value,
    CASE WHEN k % 7 <> 0 THEN 4 ELSE 0 END AS n_columns
  FROM k),
good AS (SELECT * FROM changes WHERE length("table") > 0 AND n_columns > 0),
routes(source_table, operate_type, sink_type, sink_table, cols) AS (VALUES
  ('sku_info', 'insert', 'hbase', 'dim_sku_info', 'id,name,value'),
  ('sku_info', 'update', 'hbase', 'dim_sku_info', 'id,value'),
  ('user_info', 'insert', 'hbase', 'dim_user_info', 'id,name'),
  ('base_trademark', 'insert', 'hbase', 'dim_base_trademark', 'id,name'),
  ('order_info', 'insert', 'kafka', 'dwd_order_info', 'id,value'),
  ('order_info', 'update', 'kafka', 'dwd_order_info', 'id,name,value')),
typed AS (SELECT *, CASE WHEN type = 'bootstrap-insert' THEN 'insert' ELSE type END AS op FROM good)"""

_MONEY = "DECIMAL(16,2)"
_AMOUNT = (f"CAST(CAST(l_extendedprice AS {_MONEY}) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) "
           f"AS {_MONEY})")
_T = "'%Y-%m-%d %H:%M:%S'"

_LINES = f"""lines AS (
  SELECT l_orderkey * 8 + l_linenumber AS detail_id, l_orderkey AS order_id, l_partkey AS sku_id,
    CAST(l_extendedprice AS {_MONEY}) AS order_price, CAST(l_quantity AS BIGINT) AS sku_num,
    {_AMOUNT} AS split_total_amount, o_custkey % 26 AS province_id, o_orderstatus AS order_status, o_custkey AS user_id,
    CAST(o_totalprice AS {_MONEY}) AS total_amount, CAST(10 AS {_MONEY}) AS feight_fee,
    strftime(o_orderdate, {_T}) AS create_time, strftime(o_orderdate, '%Y-%m-%d') AS create_date,
    strftime(o_orderdate, '%H') AS create_hour, o_orderdate AS order_ts, l_shipdate AS detail_ts
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    AND l_shipdate BETWEEN o_orderdate - INTERVAL 365 DAYS AND o_orderdate + INTERVAL 365 DAYS)"""

_LINE = """detail_id, order_id, sku_id, CAST(order_price AS DOUBLE) AS order_price, sku_num,
  CAST(split_total_amount AS DOUBLE) AS split_total_amount, province_id, order_status, user_id,
  CAST(total_amount AS DOUBLE) AS total_amount, CAST(feight_fee AS DOUBLE) AS feight_fee,
  create_time, create_date, create_hour"""

_PAID = """paid AS (
  SELECT p.o_orderkey AS payment_id, 'order ' || p.o_orderkey AS subject, '110' || (p.o_orderkey % 3 + 1) AS payment_type,
    strftime(p.o_orderdate, '%Y-%m-%d %H:%M:%S') AS payment_create_time,
    p.o_orderdate + to_minutes(CAST(p.o_orderkey % 40 AS INT)) AS callback_ts, lines.*
  FROM orders p JOIN lines ON p.o_orderkey = order_id
    AND order_ts BETWEEN p.o_orderdate + to_minutes(CAST(p.o_orderkey % 40 AS INT)) - INTERVAL 30 MINUTES
                     AND p.o_orderdate + to_minutes(CAST(p.o_orderkey % 40 AS INT))
  WHERE p.o_orderstatus = 'F')"""

_AGE = f"date_sub('year', DATE '1960-01-01' + CAST(c_custkey % 2500 * 7 AS INT), DATE '{AS_OF}')"

_DIMS = f"""users AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS user_gender,
    CAST({_AGE} AS INT) AS user_age FROM customer),
provinces AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS province_name, CAST(n_nationkey + 100 AS VARCHAR) AS province_area_code,
    'ISO-' || n_nationkey AS province_iso_code, 'CN-' || n_nationkey AS province_3166_2_code FROM nation),
skus AS (SELECT p_partkey AS id, p_name AS sku_name, CAST(p_retailprice AS {_MONEY}) AS sku_price, CAST(p_size AS BIGINT) AS spu_id,
    CAST(length(p_type) * 1000 + ascii(p_type) AS BIGINT) AS category3_id, CAST(substring(p_brand, 7) AS BIGINT) AS tm_id FROM part),
spus AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS id, 'spu ' || p_size AS spu_name FROM part),
cats AS (SELECT DISTINCT CAST(length(p_type) * 1000 + ascii(p_type) AS BIGINT) AS id, p_type AS category3_name FROM part),
tms AS (SELECT DISTINCT CAST(substring(p_brand, 7) AS BIGINT) AS id, p_brand AS tm_name FROM part)"""

_PRODUCT_JOINS = """LEFT JOIN skus ON sku_id = skus.id LEFT JOIN spus ON skus.spu_id = spus.id
  LEFT JOIN cats ON skus.category3_id = cats.id LEFT JOIN tms ON skus.tm_id = tms.id"""


def _bounds(width: str, ts: str = "ts") -> str:
    start = f"time_bucket(INTERVAL '{width}', {ts})"
    return f"strftime({start}, {_T}) AS stt, strftime({start} + INTERVAL '{width}', {_T}) AS edt"


_VISITOR_STATS = _REPAIRED + f""",
rows_ AS (
  SELECT vc, ch, ar, is_new, ts, 0 AS uv, 1 AS pv, CASE WHEN coalesce(last_page_id, '') = '' THEN 1 ELSE 0 END AS sv, 0 AS uj,
    coalesce(during_time, 0) AS dur FROM repaired_pages
  UNION ALL SELECT vc, ch, ar, is_new, ts, 1, 0, 0, 0, 0 FROM {_uv('repaired_pages')}
  UNION ALL SELECT vc, ch, ar, is_new, ts, 0, 0, 0, 1, 0 FROM {_uj('repaired_pages')}),
visitor_stats AS (
  SELECT {_bounds('1 hour', 'make_timestamp(ts * 1000)')}, vc, ch, ar, is_new,
    CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct,
    CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum
  FROM rows_ GROUP BY ALL)"""

_SECONDS = "date_trunc('second', ts)"

def _product_stats(shift: str = "", closed: str = "") -> str:
    """``shift`` moves the events in time, ``closed`` picks the windows."""
    return _LOGS + ",\n" + _DISPLAYS + ",\n" + _LINES + ",\n" + _PAID + f""",
metrics AS (
  SELECT make_timestamp(ts * 1000){shift} AS ts, CAST(item AS BIGINT) AS sku_id, 0 AS display, 1 AS click, 0 AS favor, 0 AS cart, 0 AS num,
    0 AS cmt, 0 AS good, CAST(0 AS {_MONEY}) AS oa, CAST(0 AS {_MONEY}) AS pa, CAST(0 AS {_MONEY}) AS ra,
    CAST(NULL AS BIGINT) AS oid, CAST(NULL AS BIGINT) AS pid, CAST(NULL AS BIGINT) AS rid
  FROM pages WHERE page_id = 'good_detail'
  UNION ALL SELECT make_timestamp(CAST(ts AS BIGINT) * 1000){shift}, CAST(item AS BIGINT), 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL
  FROM displays WHERE item_type = 'sku_id'
  UNION ALL SELECT {_SECONDS}{shift}, k, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL FROM k WHERE event_type = 'click'
  UNION ALL SELECT {_SECONDS}{shift}, k, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL FROM k WHERE event_type = 'purchase'
  UNION ALL SELECT order_ts, sku_id, 0, 0, 0, 0, sku_num, 0, 0, split_total_amount, 0, 0, order_id, NULL, NULL FROM lines
  UNION ALL SELECT callback_ts, sku_id, 0, 0, 0, 0, 0, 0, 0, 0, split_total_amount, 0, NULL, order_id, NULL FROM paid
  UNION ALL SELECT l_shipdate, l_partkey, 0, 0, 0, 0, 0, 0, 0, 0, 0, {_AMOUNT}, NULL, NULL, l_orderkey FROM lineitem
  WHERE l_returnflag = 'R'
  UNION ALL SELECT l_shipdate, l_partkey, 0, 0, 0, 0, 0, 1, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, 0, 0, 0, NULL, NULL, NULL
  FROM lineitem),
product_stats AS (
  SELECT {_bounds('1 day')}, sku_id, CAST(sum(display) AS BIGINT) AS display_ct, CAST(sum(click) AS BIGINT) AS click_ct,
    CAST(sum(favor) AS BIGINT) AS favor_ct, CAST(sum(cart) AS BIGINT) AS cart_ct, CAST(sum(num) AS BIGINT) AS order_sku_num,
    CAST(sum(cmt) AS BIGINT) AS comment_ct, CAST(sum(good) AS BIGINT) AS good_comment_ct,
    sum(oa) AS order_amount, sum(pa) AS payment_amount, sum(ra) AS refund_amount,
    count(DISTINCT oid) AS order_ct, count(DISTINCT pid) AS paid_order_ct, count(DISTINCT rid) AS refund_order_ct
  FROM metrics {closed} GROUP BY stt, edt, sku_id)"""


_PRODUCT_STATS = _product_stats()

_PRODUCT_COLUMNS = """stt, edt, sku_id, display_ct, click_ct, favor_ct, cart_ct, order_sku_num, comment_ct, good_comment_ct,
  CAST(order_amount AS DOUBLE) AS order_amount, CAST(payment_amount AS DOUBLE) AS payment_amount,
  CAST(refund_amount AS DOUBLE) AS refund_amount, order_ct, paid_order_ct, refund_order_ct"""

_SALES = _PRODUCT_STATS + ",\n" + _DIMS + f""",
sales AS (SELECT order_amount, order_ct, skus.spu_id, spu_name, skus.category3_id, category3_name, skus.tm_id, tm_name
  FROM product_stats {_PRODUCT_JOINS} WHERE stt LIKE '1998-01-15%')"""


def _top(key: str, name: str, extra: str = "") -> str:
    return f"""WITH {_SALES}
SELECT {key}, {name}, CAST(sum(order_amount) AS DOUBLE) AS order_amount{extra} FROM sales
GROUP BY {key}, {name} HAVING sum(order_amount) > 0 ORDER BY sum(order_amount) DESC, {key} LIMIT 10"""


_PROVINCE_STATS = _LINES + ",\n" + _DIMS + f""",
province_stats AS (
  SELECT {_bounds('1 day', 'order_ts')}, province_id, province_name, province_area_code AS area_code,
    province_iso_code AS iso_code, province_3166_2_code AS iso_3166_2,
    sum(split_total_amount) AS order_amount, count(DISTINCT order_id) AS order_count
  FROM lines LEFT JOIN provinces ON province_id = provinces.id
  GROUP BY stt, edt, province_id, province_name, area_code, iso_code, iso_3166_2)"""

_WORDS = "unnest(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '))"

_KEYWORD_STATS = _LOGS + f""",
search_rows AS (
  SELECT item AS full_word, make_timestamp(ts * 1000) AS ts FROM pages WHERE page_id = 'good_list' AND item IS NOT NULL
  UNION ALL SELECT text, make_timestamp((1704067200000 + doc_id * 60000) * 1000) FROM documents WHERE text IS NOT NULL),
keyword_rows AS (SELECT {_WORDS.format('full_word')} AS keyword, ts FROM search_rows),
keyword_stats AS (
  SELECT keyword, count(*) AS ct, 'SEARCH' AS source, {_bounds('1 hour')} FROM keyword_rows WHERE keyword <> '' GROUP BY keyword, stt, edt)"""

_WORD_COUNTS = f"""SELECT word, count(*) AS ct FROM (SELECT {_WORDS.format('text')} AS word FROM documents)
WHERE word <> '' GROUP BY word"""


def _half_up(n: str, d: str, factor: int) -> str:
    """n / d rounded half up at 1/factor, in whole numbers; 0 if d is 0."""
    return f"CASE WHEN {d} = 0 THEN 0 ELSE CAST((2 * {factor} * {n} + {d}) // (2 * {d}) AS DOUBLE) / {factor} END"


def _figure(label: str, expr) -> str:
    return f"SELECT '{label}' AS type, CAST({expr('n')} AS DOUBLE) AS new_user, CAST({expr('o')} AS DOUBLE) AS old_user FROM s"


_DASH_IS_NEW = f"""WITH {_VISITOR_STATS},
d AS (SELECT * FROM visitor_stats WHERE stt LIKE '2024-01-03%'),
s AS (SELECT {', '.join(
    f"CAST(coalesce(sum({m}) FILTER (WHERE is_new {op} '1'), 0) AS BIGINT) AS {side}_{m}"
    for side, op in (('n', '='), ('o', '<>')) for m in ('uv_ct', 'pv_ct', 'sv_ct', 'uj_ct', 'dur_sum'))} FROM d)
{' UNION ALL '.join([
    _figure('uv_ct', lambda s: f'{s}_uv_ct'),
    _figure('pv_ct', lambda s: f'{s}_pv_ct'),
    _figure('bounce_rate', lambda s: _half_up(f'(100 * {s}_uj_ct)', f'{s}_sv_ct', 100)),
    _figure('seconds_per_visit', lambda s: _half_up('(' + _half_up(f'{s}_dur_sum', f'{s}_sv_ct', 1) + ')::BIGINT', '1000', 10)),
    _figure('pages_per_visit', lambda s: _half_up(f'{s}_pv_ct', f'{s}_sv_ct', 100)),
])}"""

_KEPT = """CASE WHEN contains(cols, 'id') THEN id END AS id, CASE WHEN contains(cols, 'name') THEN name END AS name,
  CASE WHEN contains(cols, 'value') THEN value END AS value, CAST(len(string_split(cols, ',')) AS INT) AS n_columns"""
_ROUTED = "typed JOIN routes ON \"table\" = source_table AND op = operate_type"


# Updates lack the name; a name or value that is there may be null and then clears.
_LAST_DIM = """(arg_max({'v': name}, seq) FILTER (WHERE type <> 'update')).v AS name, arg_max({'v': value}, seq).v AS value,
  bool_or(type <> 'update') AS has_name"""


ORACLE: dict[str, str] = {
    "log_parse": f"""WITH {_LOGS}
SELECT mid, is_new, vc, ch, ar, CASE WHEN is_start THEN 2 ELSE 0 END AS start_size, page_id, last_page_id, item, during_time,
  k % 4 AS n_displays, ts FROM logs WHERE mid <> 'mid_13'""",
    "log_quarantine": """SELECT '{"common":{"mid":' AS value, count(*) AS n FROM events WHERE user_id = 13""",
    "log_split_counts": f"""WITH {_LOGS}, {_DISPLAYS}
SELECT 'start' AS route, vc, count(*) AS n FROM logs WHERE is_start GROUP BY vc
UNION ALL SELECT 'page', vc, count(*) FROM pages GROUP BY vc UNION ALL SELECT 'display', vc, count(*) FROM displays GROUP BY vc""",
    "display_explode": f"WITH {_LOGS}, {_DISPLAYS} SELECT item, item_type, page_id, ts FROM displays",
    "is_new_repair": f"WITH {_REPAIRED} SELECT mid, ts, is_new FROM repaired",
    "unique_visitor": f"WITH {_LOGS} SELECT mid, day, ts, page_id FROM {_uv('pages')}",
    "user_jump": f"WITH {_LOGS} SELECT mid, ts, page_id FROM {_uj('pages')}",
    "cdc_filter": f'WITH {_CHANGES} SELECT seq, "table", type, id, name, value, n_columns FROM good',
    "cdc_envelope": f"""WITH {_K}
SELECT event_id, 'mall' AS db, event_type AS "table",
  CASE k % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'read' WHEN 2 THEN 'update' ELSE 'delete' END AS type,
  CASE WHEN k % 4 < 3 THEN CAST(user_id AS VARCHAR) END AS id, CASE WHEN k % 4 < 3 THEN event_type END AS name,
  CASE WHEN k % 4 < 3 THEN CAST(k AS VARCHAR) END AS value, CASE WHEN k % 4 < 3 THEN 3 ELSE 0 END AS n_columns FROM k""",
    "cdc_whitelist": f"""WITH {_CHANGES}
SELECT seq, id, name, CAST(NULL AS VARCHAR) AS value, CASE WHEN n_columns > 0 THEN 2 ELSE 0 END AS n_columns FROM changes""",
    "cdc_route": f'WITH {_CHANGES} SELECT seq, "table", type, sink_type, sink_table, {_KEPT} FROM {_ROUTED}',
    "cdc_sinks": f"""WITH {_CHANGES}
SELECT CASE sink_type WHEN 'kafka' THEN 'fact' ELSE 'dim' END AS side, sink_table, count(*) AS n FROM {_ROUTED} GROUP BY ALL""",
    "cdc_unrouted": f"""WITH {_CHANGES}
SELECT seq, "table", type FROM typed ANTI JOIN routes ON "table" = source_table AND op = operate_type""",
    "cdc_config_latest": f"""WITH {_K}
SELECT source_table, operate_type, 'kafka' AS sink_type, 't' || event_id AS sink_table, 'id,name' AS sink_columns FROM (
  SELECT event_type AS source_table, CAST(user_id % 7 AS VARCHAR) AS operate_type, event_id, k FROM k
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY event_id DESC) = 1) WHERE k % 4 <> 3""",
    "dim_upsert_latest": f"""WITH {_CHANGES},
new AS (SELECT id, {_LAST_DIM} FROM good GROUP BY id),
cur AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS value FROM customer)
SELECT coalesce(new.id, cur.id) AS id, CASE WHEN has_name THEN new.name ELSE cur.name END AS name,
  CASE WHEN new.id IS NOT NULL THEN new.value ELSE cur.value END AS value
FROM cur FULL JOIN new ON cur.id = new.id""",
    "dim_sink_snapshots": f"""WITH {_CHANGES},
ordered AS (SELECT id, name, value, type, seq + CASE WHEN "table" = 'sku_info' THEN 1000000000000 ELSE 0 END AS seq FROM good
  WHERE "table" IN ('user_info', 'sku_info'))
SELECT id, name, value FROM (SELECT id, {_LAST_DIM} FROM ordered GROUP BY id)""",
    "time_functions": f"""SELECT o_orderkey, strftime(o_orderdate, {_T}) AS create_time, epoch_us(o_orderdate) // 1000 AS ms,
  strftime(o_orderdate, {_T}) AS again, strftime(o_orderdate, '%Y%m%d') AS day, {_bounds('10 seconds', 'o_orderdate')} FROM orders""",
    "order_create_parts": """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS create_date,
  strftime(o_orderdate, '%H') AS create_hour, epoch_us(o_orderdate) // 1000 AS create_ts FROM orders""",
    "order_wide_join": f"WITH {_LINES} SELECT {_LINE}, strftime(detail_ts, {_T}) AS detail_time FROM lines",
    "order_wide_user": f"WITH {_LINES}, {_DIMS} SELECT {_LINE}, user_gender, user_age FROM lines LEFT JOIN users ON user_id = users.id",
    "order_wide_province": f"""WITH {_LINES}, {_DIMS} SELECT {_LINE}, province_name, province_area_code, province_iso_code,
  province_3166_2_code FROM lines LEFT JOIN provinces ON province_id = provinces.id""",
    "order_wide_full": f"""WITH {_LINES}, {_DIMS} SELECT {_LINE}, user_gender, user_age, province_name, province_area_code,
  province_iso_code, province_3166_2_code, sku_name, skus.spu_id, spu_name, skus.category3_id, category3_name, skus.tm_id, tm_name
FROM lines LEFT JOIN users ON user_id = users.id LEFT JOIN provinces ON province_id = provinces.id {_PRODUCT_JOINS}""",
    "user_ages": f"WITH {_DIMS} SELECT id, user_gender AS gender, user_age AS age FROM users",
    "dim_multi_key": """WITH d AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_quantity) AS q FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey)
SELECT l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, n AS returns, q AS max_returned
FROM lineitem l LEFT JOIN d ON l.l_partkey = d.l_partkey AND l.l_suppkey = d.l_suppkey""",
    "payment_wide": f"""WITH {_LINES}, {_PAID}
SELECT payment_id, subject, payment_type, payment_create_time, strftime(callback_ts, {_T}) AS callback_time,
  create_time AS order_create_time, order_id, user_id, sku_id, sku_num, province_id, CAST(total_amount AS DOUBLE) AS total_amount,
  CAST(split_total_amount AS DOUBLE) AS split_total_amount FROM paid""",
    "coalesce_merge": f"""WITH r AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS {_MONEY})) AS DOUBLE) AS amount FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority WHEN l_orderkey IS NOT NULL THEN 'unknown' END AS priority,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE amount END AS amount
FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""",
    "visitor_stats": f"WITH {_VISITOR_STATS} SELECT * FROM visitor_stats",
    "product_stats": f"WITH {_PRODUCT_STATS} SELECT {_PRODUCT_COLUMNS} FROM product_stats",
    "product_stats_dims": f"""WITH {_PRODUCT_STATS}, {_DIMS}
SELECT {_PRODUCT_COLUMNS}, sku_name, skus.spu_id, spu_name, skus.category3_id, category3_name, skus.tm_id, tm_name,
  CAST(sku_price AS DOUBLE) AS sku_price FROM product_stats {_PRODUCT_JOINS}""",
    "province_stats": f"""WITH {_PROVINCE_STATS} SELECT * REPLACE (CAST(order_amount AS DOUBLE) AS order_amount) FROM province_stats""",
    "keyword_stats": f"WITH {_KEYWORD_STATS} SELECT * FROM keyword_stats",
    "keyword_stats_sql": f"WITH {_KEYWORD_STATS} SELECT * FROM keyword_stats",
    "keyword_stats_dictionary": f"""WITH dictionary AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
longest_first AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) AS p FROM dictionary WHERE word <> ''),
keyword_rows AS (SELECT unnest(regexp_extract_all(lower(replace(p_name, ' ', '')), p)) AS keyword, l_shipdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey, longest_first)
SELECT keyword, count(*) AS ct, 'SEARCH' AS source, {_bounds('1 day')} FROM keyword_rows GROUP BY keyword, stt, edt""",
    "customer_estimates": " UNION ALL ".join(f"""SELECT '{span}' AS span, strftime(date_trunc('{span}', o_orderdate), {_T}) AS start,
  count(DISTINCT o_custkey) AS customer_ct, true AS close FROM orders GROUP BY date_trunc('{span}', o_orderdate)""" for span in ("month", "year")),
    "word_counts": _WORD_COUNTS,
    "udtf_tokens": _WORD_COUNTS,
    "stats_table": f"WITH {_VISITOR_STATS} SELECT * FROM visitor_stats WHERE stt LIKE '2024-01-03%'",
    "dash_spu": _top("spu_id", "spu_name", ", CAST(sum(order_ct) AS BIGINT) AS order_ct"),
    "dash_category3": _top("category3_id", "category3_name"),
    "dash_tm": _top("tm_id", "tm_name"),
    "dash_tm_series": f"""WITH {_SALES},
top AS (SELECT tm_name, sum(order_amount) AS a FROM sales GROUP BY tm_id, tm_name HAVING sum(order_amount) > 0 ORDER BY a DESC, tm_id LIMIT 10)
SELECT string_agg(tm_name, ',' ORDER BY a DESC, tm_name DESC) AS categories,
  string_agg(CAST(a AS VARCHAR), ',' ORDER BY a DESC, tm_name DESC) AS series FROM top""",
    "dash_gmv": f"""WITH {_PRODUCT_STATS} SELECT CAST(coalesce(sum(order_amount), 0) AS DOUBLE) AS gmv FROM product_stats
WHERE stt LIKE '1998-01-15%'""",
    "dash_gmv_empty_day": f"""WITH {_PRODUCT_STATS} SELECT CAST(coalesce(sum(order_amount), 0) AS DOUBLE) AS gmv FROM product_stats
WHERE stt LIKE '2030-01-01%'""",
    "dash_hour": f"""WITH {_VISITOR_STATS},
h AS (SELECT substring(stt, 12, 2) AS hr, sum(uv_ct) AS uv, sum(pv_ct) AS pv, sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS nu
  FROM visitor_stats WHERE stt LIKE '2024-01-03%' GROUP BY 1)
SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS hr, CAST(coalesce(uv, 0) AS BIGINT) AS uv_ct, CAST(coalesce(pv, 0) AS BIGINT) AS pv_ct,
  CAST(coalesce(nu, 0) AS BIGINT) AS new_uv
FROM generate_series(0, 23) g(i) LEFT JOIN h ON h.hr = lpad(CAST(i AS VARCHAR), 2, '0')""",
    "dash_is_new": _DASH_IS_NEW,
    "dash_novelty": f"""WITH {_VISITOR_STATS} SELECT is_new, {', '.join(
        f"CAST(sum({m}) AS BIGINT) AS {m}" for m in ('uv_ct', 'pv_ct', 'sv_ct', 'uj_ct', 'dur_sum'))}
FROM visitor_stats WHERE stt LIKE '2024-01-03%' GROUP BY is_new""",
    "dash_map": f"""WITH {_PROVINCE_STATS} SELECT province_name AS name, CAST(sum(order_amount) AS DOUBLE) AS value
FROM province_stats WHERE stt LIKE '1998-01-15%' GROUP BY province_id, province_name""",
    "dash_keyword": f"""WITH {_KEYWORD_STATS} SELECT keyword AS name, CAST(sum(ct * 10) AS BIGINT) AS value FROM keyword_stats
WHERE stt LIKE '2024-01-01%' GROUP BY keyword ORDER BY value DESC, keyword LIMIT 10""",
}

# --- streams: the same rows, less the windows the watermark has not passed -----


def _closed(width: str, ts: str, last: str, delay: str = "3 seconds") -> str:
    """Windows of ``width`` that end at or before the watermark."""
    return f"time_bucket(INTERVAL '{width}', {ts}) + INTERVAL '{width}' <= {last} - INTERVAL '{delay}'"


def _route_keys(rows: list[tuple]) -> str:
    return ", ".join(f"('{r[0]}', '{r[1]}')" for r in rows)


_PAGE_TIME = "make_timestamp(ts * 1000)"
_SHIFT = f" - INTERVAL {EVENT_SHIFT_DAYS} DAYS"
# The watermark of the slowest of seven inputs, less its delay.
_SLOWEST = f"""least((SELECT max({_PAGE_TIME}){_SHIFT} FROM pages), (SELECT max({_SECONDS}){_SHIFT} FROM k WHERE event_type = 'click'),
  (SELECT max({_SECONDS}){_SHIFT} FROM k WHERE event_type = 'purchase'), (SELECT max(order_ts) FROM lines),
  (SELECT max(callback_ts) FROM paid), (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag = 'R'),
  (SELECT max(l_shipdate) FROM lineitem))"""
_TIMEOUT = "INTERVAL '4 hours'"

_STREAM_PROVINCES = f"""WITH {_LINES}, {_DIMS}
SELECT {_bounds('1 day', 'order_ts')}, province_id, province_name, province_area_code AS area_code, province_iso_code AS iso_code,
  province_3166_2_code AS iso_3166_2, CAST(sum(split_total_amount) AS DOUBLE) AS order_amount, count(DISTINCT order_id) AS order_count
FROM lines LEFT JOIN provinces ON province_id = provinces.id
WHERE {_closed('1 day', 'order_ts', '(SELECT max(order_ts) FROM lines)')} GROUP BY ALL"""

ORACLE.update({
    "stream_is_new_repair": ORACLE["is_new_repair"],
    "stream_unique_visitor": ORACLE["unique_visitor"],
    "stream_user_jump": f"""WITH {_LOGS} SELECT mid, ts, page_id FROM {_uj('pages')}
WHERE time_bucket({_TIMEOUT}, {_PAGE_TIME}) + {_TIMEOUT} + {_TIMEOUT} <= (SELECT max({_PAGE_TIME}) FROM pages)""",
    "stream_order_join": f"""WITH {_LINES} SELECT detail_id, order_id, sku_id, sku_num, user_id, create_time,
  strftime(detail_ts, {_T}) AS detail_time FROM lines""",
    "stream_visitor_stats": f"""WITH {_REPAIRED},
jumps AS (SELECT * FROM {_uj('repaired_pages')}
  WHERE time_bucket({_TIMEOUT}, {_PAGE_TIME}) + {_TIMEOUT} + {_TIMEOUT} <= (SELECT max({_PAGE_TIME}) FROM pages)),
uniques AS (SELECT * FROM {_uv('repaired_pages')}),
rows_ AS (
  SELECT vc, ch, ar, is_new, ts, 0 AS uv, 1 AS pv, CASE WHEN coalesce(last_page_id, '') = '' THEN 1 ELSE 0 END AS sv, 0 AS uj,
    coalesce(during_time, 0) AS dur FROM repaired_pages
  UNION ALL SELECT vc, ch, ar, is_new, ts, 1, 0, 0, 0, 0 FROM uniques
  UNION ALL SELECT vc, ch, ar, is_new, ts, 0, 0, 0, 1, 0 FROM jumps)
SELECT {_bounds('1 hour', _PAGE_TIME)}, vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct,
  CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum
FROM rows_ WHERE {_closed('1 hour', _PAGE_TIME, f"(SELECT max({_PAGE_TIME}) FROM rows_)")}
GROUP BY ALL""",
    "stream_payment_wide": ORACLE["payment_wide"],
    "stream_product_stats": f"""WITH {_product_stats(_SHIFT, 'WHERE ' + _closed('1 day', 'ts', _SLOWEST))}
SELECT {_PRODUCT_COLUMNS} FROM product_stats""",
    "stream_province_stats": _STREAM_PROVINCES,
    "stream_order_wide_dims": f"""WITH {_LINES}, {_DIMS},
when_joined AS (SELECT *, greatest(order_ts, detail_ts) < TIMESTAMP '{CUT}' AS early FROM lines)
SELECT detail_id, order_id, CASE WHEN early THEN user_gender END AS user_gender,
  CASE WHEN early OR province_id % 2 = 1 THEN province_name ELSE province_name || ' renamed' END AS province_name,
  sku_name, spu_name, category3_name, tm_name, CAST(split_total_amount AS DOUBLE) AS split_total_amount
FROM when_joined LEFT JOIN users ON user_id = users.id LEFT JOIN provinces ON province_id = provinces.id {_PRODUCT_JOINS}""",
    "stream_late_rows": f"""WITH {_K},
e AS (SELECT ts, time_bucket(INTERVAL '1 hour', ts) AS w, ts >= TIMESTAMP '{CONFIG_CUT}' OR k % 10 = 0 AS second FROM k)
SELECT strftime(w, {_T}) AS stt, count(*) AS late_ct FROM e
WHERE second AND w + INTERVAL '1 hour' <= (SELECT max(ts) FROM e WHERE NOT second) - INTERVAL '1 day' GROUP BY w""",
    "stream_cdc_route": f"""WITH {_CHANGES},
later AS (SELECT * FROM routes WHERE (source_table, operate_type) NOT IN ({_route_keys(CHANGED_ROUTES + GONE_ROUTES)})
  UNION ALL VALUES {', '.join(str(r[:5]) for r in CHANGED_ROUTES)}),
half AS (SELECT typed.*, ts < TIMESTAMP '{CONFIG_CUT}' AS early FROM typed JOIN events ON seq = event_id),
all_routes AS (SELECT true AS early_route, * FROM routes UNION ALL SELECT false, * FROM later)
SELECT seq, "table", type, sink_type, sink_table, {_KEPT}
FROM half JOIN all_routes ON early = early_route AND "table" = source_table AND op = operate_type""",
    "stream_replayed_orders": f"""WITH {_LINES}
SELECT {_bounds('1 day', 'order_ts')}, province_id, CAST(sum(split_total_amount) AS DOUBLE) AS order_amount,
  count(DISTINCT order_id) AS order_count
FROM lines WHERE {_closed('1 day', 'order_ts', '(SELECT max(order_ts) FROM lines)')} GROUP BY stt, edt, province_id""",
    "stream_province_stats_sql": _STREAM_PROVINCES,
    "stream_keyword_stats_sql": f"""WITH {_KEYWORD_STATS},
last_page AS (SELECT greatest((SELECT max(make_timestamp(ts * 1000)) FROM pages),
  (SELECT max(make_timestamp((1704067200000 + doc_id * 60000) * 1000)) FROM documents)) AS t)
SELECT keyword, ct, source, stt, edt FROM keyword_stats, last_page WHERE CAST(edt AS TIMESTAMP) <= t - INTERVAL '3 seconds'""",
    "stream_keyword_stats": f"""WITH keyword_rows AS (SELECT {_WORDS.format('text')} AS keyword,
  make_timestamp((1704067200000 + doc_id * 60000) * 1000) AS ts FROM documents)
SELECT keyword, count(*) AS ct, 'SEARCH' AS source, {_bounds('1 hour')} FROM keyword_rows
WHERE keyword <> '' AND {_closed('1 hour', 'ts', '(SELECT max(ts) FROM keyword_rows)')} GROUP BY keyword, stt, edt""",
})

# Another spelling of the same numbers.
ORACLE["log_parse_coerced"] = ORACLE["log_parse"]
