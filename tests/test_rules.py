"""Hand-made cases for each rule, and brute-force checks on skewed random data."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martflow import schemas
from martflow.functions import rates, text, times
from martflow.operators import enrich, orders, parse, routing, stats, visits
from martflow.operators.intervals import interval_join
from martflow.plans import dashboard, queries
from martflow.session import materialize, work_root
from martflow.sinks import dims as dim_sink
from martflow.sources import changes

DAY = 86400_000
T0 = 1704067200000


def logs(spark, rows):
    """rows: (mid, ts_ms, is_new, page_id, last_page_id[, item, displays, start])"""
    out = []
    for r in rows:
        mid, ts, is_new, page_id, last, item, displays, start = (list(r) + [None] * 8)[:8]
        out.append(((mid, is_new, "v", "c", "a"), start, (page_id, last, item, 1), displays, T0 + ts))
    return spark.createDataFrame(out, schemas.PAGE_LOG)


def repaired(spark, rows):
    out = visits.repair_is_new(logs(spark, rows)).select("common.mid", "ts", "common.is_new").collect()
    return {(r.mid, r.ts - T0): r.is_new for r in out}


def test_new_flag_is_kept_on_the_first_day_only(spark):
    got = repaired(spark, [("m", 0, "1", "p", None), ("m", 1, "1", "p", None), ("m", DAY, "1", "p", None),
                           ("m", DAY + 1, "0", "p", None), ("n", 0, "0", "p", None), ("n", DAY, "1", "p", None)])
    assert got == {("m", 0): "1", ("m", 1): "1", ("m", DAY): "0", ("m", DAY + 1): "0", ("n", 0): "0", ("n", DAY): "1"}


def test_unique_visitor_is_the_first_entry_of_the_day(spark):
    rows = visits.unique_visitors(logs(spark, [
        ("m", 0, "0", "p", None), ("m", 5, "0", "p", ""), ("m", DAY, "0", "p", "home"), ("m", DAY + 9, "0", "p", None)]))
    assert {r.ts - T0 for r in rows.collect()} == {0, DAY + 9}


@pytest.mark.parametrize("rows, bounced", [
    ([(0, "p", None), (5000, "q", "p")], []),
    ([(0, "p", None), (10000, "q", "p")], [0]),
    ([(0, "p", None), (9999, "q", "p")], []),
    ([(0, "p", None), (4000, "p", None)], [4000]),
    ([(0, "p", None), (3000, "", "p")], []),
    ([(0, "p", None)], [0]),
    ([(9000, "p", None), (18500, "q", "p")], []),
    ([(9000, "p", None), (19500, "q", "p")], [9000]),
])
def test_bounce_rule(spark, rows, bounced):
    got = visits.bounces(logs(spark, [("m", ts, "0", p, last) for ts, p, last in rows])).collect()
    assert sorted(r.ts - T0 for r in got) == bounced


def test_bounces_against_brute_force_with_a_hot_device(spark):
    rng = random.Random(7)
    rows, used = [], set()
    for _ in range(3000):
        mid = "hot" if rng.random() < 0.4 else f"m{rng.randrange(50)}"
        ts = rng.randrange(0, 2_000_000)
        if (mid, ts) not in used:
            used.add((mid, ts))
            rows.append((mid, ts, "0", rng.choice(["p", "q", ""]), rng.choice([None, "", "home"])))
    want = set()
    for mid, ts, _, _, last in rows:
        later = [t for m, t in used if m == mid and t > ts]
        if not last and (not later or min(later) - ts >= 10_000):
            want.add((mid, ts))
    got = visits.bounces(logs(spark, rows)).select("common.mid", "ts").collect()
    assert len(got) == len(want) and {(r.mid, r.ts - T0) for r in got} == want


def test_log_split(spark):
    shown = [("1", "sku_id"), ("2", "x"), ("3", "sku_id")]
    df = logs(spark, [("s", 0, "0", None, None, None, shown, ("icon", 1)), ("p", 1, "0", "home", None, None, shown),
                      ("e", 2, "0", "home", None, None, [])])
    assert routing.start_logs(df).count() == 1 and routing.page_logs(df).count() == 2
    assert [(r.item, r.page_id, r.ts) for r in routing.display_logs(df).collect()] == [
        (i, "home", str(T0 + 1)) for i in "123"]


def changes_df(spark, rows):
    return spark.createDataFrame(rows, schemas.CHANGE_RECORD)


def test_change_filter_and_whitelist(spark):
    df = changes_df(spark, [("t", "insert", {"id": "1", "tm_name": "a", "logo_url": "u"}), ("t", "insert", {}),
                            ("t", "insert", None), ("", "insert", {"id": "1"})])
    good = routing.well_formed(df)
    assert good.count() == 1
    assert good.select(routing.keep_columns("data", F.lit("id,tm_name"))).first()[0] == {"id": "1", "tm_name": "a"}


def test_routing_and_its_misses(spark):
    df = changes_df(spark, [("t", "bootstrap-insert", {"id": "1", "x": "2"}), ("t", "delete", {"id": "1"})])
    routes = spark.createDataFrame([("t", "insert", "hbase", "dim_t", "id", None, None)], schemas.TABLE_PROCESS)
    assert [(r.sink_table, r.data) for r in routing.route(df, routes).collect()] == [("dim_t", {"id": "1"})]
    assert [r.type for r in routing.unrouted(df, routes).collect()] == ["delete"]


def test_envelopes(spark):
    values = ['{"op":"%s","after":%s,"source":{"db":"d","table":"t"},"ts_ms":1}' % (op, "null" if op == "d" else '{"id":7}')
              for op in "crud"]
    out = changes.normalise_envelopes(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert [(r.type, r.data) for r in out] == [("insert", {"id": "7"}), ("read", {"id": "7"}), ("update", {"id": "7"}), ("delete", {})]


def test_dimension_upsert_clears_on_null_and_keeps_what_is_absent(spark, tmp_path):
    table = dim_sink.DimTable(str(tmp_path / "dim"), ("id", "name", "age"), ("id",))
    table.create(spark)
    fields = "seq int, id string, name string, age string, present array<string>"
    absent, whole = ["id", "name"], ["id", "name", "age"]
    rows = spark.createDataFrame([(1, "1", "a", None, absent), (2, "1", "b", "3", whole), (3, "1", "c", None, absent)], fields)
    table.upsert(rows, "seq", 1)
    table.upsert(rows, "seq", 1)  # a replay changes nothing
    assert [tuple(r) for r in table.read(spark).collect()] == [("1", "c", "3")]
    more = lambda *r: spark.createDataFrame(list(r), rows.schema)
    table.upsert(more((1, "1", None, "4", ["id", "age"]), (1, "2", "z", "9", whole)), "seq", 2)
    table.upsert(more((1, "2", "z", "9", whole)), "seq", 3, deleted=spark.createDataFrame([("2",)], "id string"))
    read = lambda upto=None: sorted(tuple(r) for r in table.read(spark, upto).collect())
    assert read() == [("1", "c", "4")] and read(2) == [("1", "c", "4"), ("2", "z", "9")]
    table.upsert(more((1, "2", "y", None, absent)), "seq", 4)
    for _ in range(2):
        assert read() == [("1", "c", "4"), ("2", "y", None)]
        table.compact(spark, 3)
    table.compact(spark, 4)
    assert read() == [("1", "c", "4"), ("2", "y", None)]
    table.upsert(more((1, "1", "d", "5", whole), (2, "1", None, "5", absent), (3, "2", None, "7", ["id", "age"])), "seq", 5)
    for _ in range(2):
        assert read() == [("1", None, "5"), ("2", "y", "7")]
        table.compact(spark, 5)
    base = spark.createDataFrame([("1", "a", "1"), ("3", "b", "2")], "id string, name string, age string")
    last = dim_sink.last_values(rows.unionByName(more((4, "3", None, None, absent))), ["id"], ["id", "name", "age"], "seq")
    assert sorted(map(tuple, dim_sink.merge(base, last, ["id"], ["id", "name", "age"]).collect())) == [
        ("1", "c", "3"), ("3", None, "2")]
    assert dim_sink.key_columns("id,name") == ["id", "name"] and dim_sink.key_columns(None) == ["id"]


def test_config_deletes_remove_the_route(spark):
    row = '{"source_table":"t","operate_type":"%s","sink_type":"kafka","sink_table":"s%d"}'
    feed = [('c', None, row % ("insert", 1), 1), ('u', None, row % ("insert", 2), 2), ('c', None, row % ("update", 3), 1),
            ('d', row % ("update", 3), None, 2)]
    values = ['{"op":"%s","before":%s,"after":%s,"source":{},"ts_ms":%d}' % (op, b or "null", a or "null", ts) for op, b, a, ts in feed]
    out = changes.routes(changes.normalise_envelopes(spark.createDataFrame([(v,) for v in values], "value string")))
    assert [(r.source_table, r.operate_type, r.sink_table) for r in out.collect()] == [("t", "insert", "s2")]


def test_interval_join_bounds(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 10)
    anchors = spark.createDataFrame([(1, base)], "a int, at timestamp")
    offsets = [-5.001, -5.0, 0.0, 5.0, 5.001]
    points = spark.createDataFrame([(1, base + dt.timedelta(seconds=o), o) for o in offsets], "b int, bt timestamp, o double")
    assert sorted(r.o for r in interval_join(anchors, points, ("a", "b"), ("at", "bt"), 5, 5).collect()) == [-5, 0, 5]
    minutes = [-1, 0, 1800, 1801]
    wide = spark.createDataFrame([(1, base - dt.timedelta(seconds=m), m) for m in minutes], "b int, bt timestamp, m int")
    assert sorted(r.m for r in interval_join(anchors, wide, ("a", "b"), ("at", "bt"), 1800, 0).collect()) == [0, 1800]


def test_interval_join_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    base = dt.datetime(1969, 12, 31, 23, 50)  # slices must work across the epoch
    make = lambda n: [(1 if rng.random() < 0.4 else rng.randrange(40), base + dt.timedelta(milliseconds=rng.randrange(1_200_000)), i)
                      for i in range(n)]
    left, right = make(300), make(900)
    want = {(x[2], y[2]) for x in left for y in right
            if x[0] == y[0] and -dt.timedelta(seconds=7) <= y[1] - x[1] <= dt.timedelta(seconds=2)}
    got = interval_join(spark.createDataFrame(left, "a int, at timestamp, x int"), spark.createDataFrame(right, "b int, bt timestamp, y int"),
                        ("a", "b"), ("at", "bt"), 7, 2).select("x", "y").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_lookup_keeps_rows_without_a_match(spark):
    dims = {"sku": spark.createDataFrame([(1, "s", Decimal("2.00"), 10, 20, 30)],
                                         "id bigint, sku_name string, price decimal(16,2), spu_id bigint, category3_id bigint, tm_id bigint"),
            "spu": spark.createDataFrame([(10, "p")], "id bigint, spu_name string"),
            "category3": spark.createDataFrame([(20, "c")], "id bigint, name string"),
            "trademark": spark.createDataFrame([(30, "t")], "id bigint, tm_name string")}
    rows = spark.createDataFrame([(1, "old"), (2, "kept?")], "sku_id bigint, sku_name string")
    got = {r.sku_id: r for r in enrich.add_product(rows, dims, price=True).collect()}
    assert (got[1].sku_name, got[1].spu_name, got[1].category3_name, got[1].tm_name, got[1].sku_price) == ("s", "p", "c", "t", Decimal("2.00"))
    assert tuple(got[2])[1:] == (None,) * 8
    assert enrich.one_per_key(spark.createDataFrame([(1, 2), (1, 3)], "id int, v int"), ["id"]).count() == 1


@pytest.mark.parametrize("as_of, age", [("2023-02-28", 22), ("2023-03-01", 23)])
def test_age(spark, as_of, age):
    df = spark.createDataFrame([("2000-02-29",)], "birthday string")
    assert df.select(times.age_in_years("birthday", F.lit(as_of).cast("date"))).first()[0] == age


def product_rows(spark, lines):
    """lines: (sku, order, second, num, amount)"""
    base = dt.datetime(2024, 1, 1)
    wide = spark.createDataFrame([(sku, o, n, Decimal(a), base + dt.timedelta(seconds=t)) for sku, o, t, n, a in lines],
                                 "sku_id bigint, order_id bigint, sku_num bigint, split_total_amount decimal(16,2), create_time timestamp")
    out = stats.product_stats(stats.order_rows(wide)).orderBy("stt", "sku_id").collect()
    return [(r.stt[-8:], r.edt[-8:], r.sku_id, r.order_ct, r.order_sku_num, str(r.order_amount)) for r in out]


def test_product_order_counts(spark):
    assert product_rows(spark, [(1, 5, 0, 1, "1.50")]) == [("00:00:00", "00:00:10", 1, 1, 1, "1.50")]
    assert product_rows(spark, [(1, 5, 0, 1, "1.50"), (1, 5, 9, 2, "2.25"), (1, 6, 3, 1, "1.00"), (1, 5, 10, 1, "9.99")]) == [
        ("00:00:00", "00:00:10", 1, 2, 4, "4.75"), ("00:00:10", "00:00:20", 1, 1, 1, "9.99")]


def test_province_counts_an_order_once_per_window(spark):
    base = dt.datetime(2024, 1, 1)
    wide = spark.createDataFrame([(1, o, Decimal("1.00"), base + dt.timedelta(seconds=t)) for o, t in ((5, 0), (5, 1), (6, 2), (5, 11))],
                                 "province_id bigint, order_id bigint, split_total_amount decimal(16,2), create_time timestamp")
    for c in ("province_name", "province_area_code", "province_iso_code", "province_3166_2_code"):
        wide = wide.withColumn(c, F.lit(None).cast("string"))
    out = stats.province_stats(wide).orderBy("stt").collect()
    assert [(r.order_count, str(r.order_amount)) for r in out] == [(2, "3.00"), (1, "1.00")]


def test_first_non_null_merge(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "b", None)], "id int, p string, q string")
    b = spark.createDataFrame([(1, "c", "y")], "id int, p string, q string")
    assert sorted(tuple(r) for r in orders.first_non_null(a, b, ["id"]).collect()) == [(1, "c", "x"), (2, "b", None)]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 3, 12345, 2), (1, 1, 1, 0), (1, 201, 0, 200)], "uj bigint, pv bigint, dur bigint, sv bigint")
    sv = F.col("sv")
    got = [tuple(map(str, r)) for r in df.select(
        rates.bounce_rate(F.col("uj"), sv), rates.seconds_per_visit(F.col("dur"), sv), rates.pages_per_visit(F.col("pv"), sv)).collect()]
    assert got == [("50.00", "6.2", "1.50"), ("0.00", "0.0", "0.00"), ("0.50", "0.0", "1.01")]


def test_words(spark):
    df = spark.createDataFrame([("Red phone, RED!",), ("...",), ("",), (None,), ("Été 2024",)], "full_word string").withColumn("ts", F.current_timestamp())
    assert [r.keyword for r in stats.keywords(df).collect()] == ["red", "phone", "red", "été", "2024"]
    chars = text.word_splitter(list)
    assert [r.keyword for r in stats.keywords(df.limit(1), chars).collect()] == list("Red phone, RED!")
    text.register_word_table_function(spark, "ik_analyze")
    df.createOrReplaceTempView("texts")
    assert spark.sql("SELECT word FROM texts, LATERAL ik_analyze(full_word)").count() == 5


def test_parse_and_quarantine(spark):
    df = spark.createDataFrame([('{"common":{"mid":"m"},"ts":5}',), ("{broken",), ("[1]",), (None,), ('{"ts":"x"}',)], "value string")
    assert [(r.mid, r.ts) for r in parse.parse(df, schemas.RAW_LOG).select("common.mid", "ts").collect()] == [("m", 5), (None, None)]
    assert parse.malformed(df, schemas.RAW_LOG).count() == 3
    typed = parse.parse_record(spark.createDataFrame([('{"sku_id":"7","create_time":"t"}',), ('{"sku_id":8}',)], "value string"), schemas.SKU_EVENT)
    assert [tuple(r) for r in typed.collect()] == [(7, "t"), (8, None)]
    assert parse.serialise(typed).first().value == '{"sku_id":7,"create_time":"t"}'


def test_dashboard_edges(spark):
    visitor = spark.createDataFrame([("2024-01-01 05:00:00", "1", 1, 2, 0, 0, 10), ("2024-01-02 05:00:00", "0", 9, 9, 9, 9, 9)],
                                    "stt string, is_new string, uv_ct bigint, pv_ct bigint, sv_ct bigint, uj_ct bigint, dur_sum bigint")
    hours = dashboard.visitors_by_hour(visitor, 20240101).orderBy("hr").collect()
    assert len(hours) == 24 and sum(r.uv_ct for r in hours) == 1 and (hours[5].hr, hours[5].new_uv) == ("05", 1)
    figures = {r.type: (float(r.new_user), float(r.old_user)) for r in dashboard.new_versus_returning(visitor, 20240101).collect()}
    assert figures == {"uv_ct": (1, 0), "pv_ct": (2, 0), "bounce_rate": (0, 0), "seconds_per_visit": (0, 0), "pages_per_visit": (0, 0)}
    assert dashboard.visitors_by_novelty(visitor, 20240101).count() == 1
    product = spark.createDataFrame([("2024-01-01 00:00:00", 1, "a", Decimal("0.00"), 1), ("2024-01-01 00:00:00", 2, "b", Decimal("3.00"), 1)],
                                    "stt string, spu_id bigint, spu_name string, order_amount decimal(28,2), order_ct bigint")
    assert [r.spu_name for r in dashboard.top_spu(product, 20240101).collect()] == ["b"]
    assert float(dashboard.gmv(product, 20250101).first().gmv) == 0
    words = spark.createDataFrame([("k", 3, "SEARCH", "2024-01-01 00:00:00"), ("k", 4, "CART", "2024-01-01 00:00:00"), ("k", 9, "OTHER", "2024-01-01 00:00:00")],
                                  "keyword string, ct bigint, source string, stt string")
    assert dashboard.hot_keywords(words, 20240101).first().ct == 38


def test_shared_folder_is_read_from_the_session(spark):
    assert work_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(3), "three")
    assert df.count() == 3 and all(work_root(spark) in f for f in df.inputFiles())


def test_plans_combine_before_the_shuffle(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    uniques = plan(visits.unique_visitors(logs(spark, [("m", 0, "0", "p", None)])))
    assert "WindowGroupLimit" in uniques and "Partial" in uniques
    jumps = plan(visits.bounces(logs(spark, [("m", 0, "0", "p", None)])))
    assert "partial_max_by" in jumps and "Window [" not in jumps


def test_numbers_of_a_log_may_be_text(spark):
    values = ['{"page":{"during_time":"5"},"ts":"1000"}', '{"page":{"during_time":5.0},"ts":1000.0}',
              '{"page":{"during_time":"x"},"ts":1000}', "[1", "no"]
    rows = parse.parse(spark.createDataFrame([(v,) for v in values], "value string"), schemas.PAGE_LOG)
    assert sorted((r.page.during_time or 0, r.ts) for r in rows.collect()) == [(0, 1000), (5, 1000), (5, 1000)]


def test_column_lists_are_trimmed(spark):
    row = spark.sql("SELECT map('id', '1', 'name', 'a', 'x', 'b') AS data").select(
        routing.keep_columns("data", F.lit("id, name")).alias("d")).first()
    assert row.d == {"id": "1", "name": "a"}


def test_table_function_stays_in_the_jvm(spark):
    from martflow.functions.text import register_word_table_function

    register_word_table_function(spark, "split_words")
    rows = spark.sql("SELECT t.word FROM VALUES ('Ab-c \u00e9'), (NULL), ('') AS v(x), LATERAL split_words(x) t")
    assert [r.word for r in rows.collect()] == ["ab", "c", "\u00e9"]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_day_reports_push_their_day_to_the_scans(spark):
    def pushed(query):
        plan = queries.BATCH[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        return " ".join(line for line in plan.splitlines() if "PushedFilters" in line)

    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    by_map, by_word = pushed("dash_map"), pushed("dash_keyword")
    for column, plan in (("o_orderdate", by_map), ("l_shipdate", by_map), ("ts", by_word)):
        assert re.search(rf"GreaterThanOrEqual\({column},", plan) and re.search(rf"LessThan\({column},", plan), column
