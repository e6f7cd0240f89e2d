"""Repeats, dictionary words, sketches, late rows, routes and wanted keys, on hand-made rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from martflow import schemas
from martflow.functions import segment
from martflow.operators import sketches, stats
from martflow.operators.repeats import each_once
from martflow.sinks.dims import DimTable
from martflow.sources import changes
from martflow.streaming import late
from martflow.streaming.replay import _run
from martflow.streaming.routes import with_routes


def test_longest_match_is_taken_from_the_left():
    root = segment.trie_of(["red", "redphone", "phone", "case", "a", ""])
    cut = lambda t: list(segment.longest_matches(t, root))
    assert cut("redphonecase") == ["redphone", "case"] and cut("xredx") == ["red"] and cut("") == [] and cut("zzz") == []
    assert cut("redphon") == ["red"] and cut("aared") == ["a", "a", "red"]


def test_segmenter_against_brute_force():
    rng = random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(12)}
    root = segment.trie_of(words)
    for _ in range(300):
        text, at, want = "".join(rng.choices("abcd", k=rng.randrange(30))), 0, []
        while at < len(text):
            best = max((w for w in words if text.startswith(w, at)), key=len, default="")
            want += [best] if best else []
            at += len(best) or 1
        assert list(segment.longest_matches(text, root)) == want


def test_dictionary_words_in_frames_and_sql(spark, monkeypatch):
    dictionary = spark.createDataFrame([("手机",), ("红色手机",), ("Case",), (None,), ("",)], "word string")
    found = segment.load(dictionary, "word")
    assert found == ["case", "手机", "红色手机"]
    rows = spark.createDataFrame([("红色手机CASE手机",), (None,), ("",), ("无",)], "full_word string").withColumn("ts", F.lit(None).cast("timestamp"))
    assert [r.keyword for r in stats.keywords(rows, segment.dictionary_words(found)).collect()] == ["红色手机", "case", "手机"]
    segment.register_dictionary_function(spark, found, "ik_cut")
    rows.createOrReplaceTempView("searches")
    assert [r.w for r in spark.sql("SELECT explode(ik_cut(full_word)) AS w FROM searches").collect()] == ["红色手机", "case", "手机"]
    monkeypatch.setattr(segment, "MAX_WORDS", 2)
    with pytest.raises(ValueError):
        segment.load(dictionary, "word")


def test_sketches_merge_to_longer_spans(spark):
    day = F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 40) * 86400).alias("t")
    rows = spark.range(60_000).select(day, (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") % 20_011).alias("v"))
    daily = sketches.window_sketches(rows, "t", "1 day", ["k"], "v")
    assert daily.count() == 40 * 7
    for r in sketches.merged(daily, "month", []).join(
            rows.groupBy(F.date_trunc("month", "t").alias("start")).agg(F.count_distinct("v").alias("exact")), "start").collect():
        assert abs(r.distinct_ct - r.exact) <= 0.02 * r.exact


def test_each_once_tells_updates_from_repeats(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:00:00"),
                                  (None, "a", None), (None, "a", None)], "id int, v string, t string")
    rows = rows.withColumn("t", F.to_timestamp("t"))
    assert sorted((r.id or 0, r.v) for r in each_once(rows, "t", ["id"]).collect()) == [(0, "a"), (1, "a"), (1, "b")]


def stream_of(spark, folder, batches, schema):
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        with open(f"{folder}/{i}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(f"{folder}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_late_rows_are_kept(spark, tmp_path):
    """Delay 3 s, windows of 10 s.  Lateness is judged by the watermark of the batch before."""
    at = lambda *seconds: [{"t": f"2024-01-01T00:00:{s:02d}Z", "s": s} for s in seconds]
    rows = stream_of(spark, f"{tmp_path}/in", [at(1, 25), at(2, 19, 21, 30), at(12, 29, 8) + [{"t": None, "s": 99}]], "t timestamp, s int")
    kept = []

    def write(batch, batch_id):
        batch.persist()
        kept.extend((batch_id, r.s, r.missed.second) for r in late.late_rows(batch, "t", "10 seconds").collect())
        batch.unpersist()

    opened = late.with_open_windows(rows, "t", "10 seconds", "3 seconds")
    _run(opened.writeStream.outputMode("update").foreachBatch(write), str(tmp_path), [])
    assert sorted(kept) == [(2, 8, 0), (2, 12, 10)]


def test_routes_follow_the_configuration(spark, tmp_path):
    """A row is routed by the configuration of its micro-batch, earlier rows of it included."""
    def config(table, sink, ts, op="c"):
        row = {"source_table": table, "operate_type": "insert", "sink_type": "kafka", "sink_table": sink, "sink_columns": "id"}
        return {"value": json.dumps({"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row, "ts_ms": ts})}

    record = lambda table, n: {"table": table, "type": "bootstrap-insert", "data": {"id": str(n)}}
    rows = stream_of(spark, f"{tmp_path}/rows", [[record("a", 1), record("b", 2)], [record("a", 3)], [record("a", 4), record("b", 5)],
                                                 [record("a", 6), record("c", 7)]], schemas.CHANGE_RECORD)
    feed = stream_of(spark, f"{tmp_path}/config", [[config("a", "t1", 1), config("a", "old", 0)], [], [config("b", "t2", 2)],
                                                   [config("a", "t1", 3, "d")]], "value string")
    tagged = with_routes(rows.select(F.struct("*").alias("row")), changes.normalise_envelopes(feed))
    seen = []

    def write(batch, batch_id):
        batch.persist()
        routes = {r.source_table: r.sink_table for r in batch.where("route is not null").select("route.*").collect()}
        seen.extend((int(r.data["id"]), routes.get(r.table)) for r in batch.where("row is not null").select("row.*").collect())
        batch.unpersist()

    _run(tagged.writeStream.outputMode("update").foreachBatch(write), str(tmp_path), [])
    assert sorted(seen) == [(1, "t1"), (2, None), (3, "t1"), (4, "t1"), (5, "t2"), (6, None), (7, None)]


def test_wanted_keys_are_read_alone(spark, tmp_path):
    table = DimTable(str(tmp_path / "dim"), ("id", "name"), ("id",), compact_every=3)
    assert table.stamp(spark) == (-1, -1) and table.read(spark).count() == 0
    table.create(spark)
    for version in range(1, 6):
        rows = spark.range(100).select(F.lit(1).alias("seq"), F.col("id").cast("string").alias("id"),
                                       F.lit(f"v{version}").alias("name"), F.array(F.lit("id"), F.lit("name")).alias("present"))
        table.upsert(rows.where(f"id % {version} = 0"), "seq", version)
    assert table.stamp(spark) == (3, 5)
    wanted = spark.createDataFrame([("60",), ("8",), ("7",), ("7",), (None,), ("none",)], "id string")
    assert sorted(map(tuple, table.read(spark, wanted=wanted).collect())) == [("60", "v5"), ("7", "v1"), ("8", "v4")]
    assert table.read(spark).count() == 100 and table.read(spark, upto=3, wanted=wanted).where("id = '60'").first().name == "v3"
    # A later upsert may know fewer columns; a snapshot keeps those of all.
    narrow = DimTable(table.path, ("id", "other"), ("id",), compact_every=6)
    more = spark.createDataFrame([(1, "7", "o", ["id", "other"])], "seq int, id string, other string, present array<string>")
    narrow.upsert(more, "seq", 6)
    whole = DimTable(table.path, ("id", "name", "other"), ("id",))
    assert tuple(whole.read(spark, wanted=wanted.where("id = '7'")).first()) == ("7", "v1", "o")
