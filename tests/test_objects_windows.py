"""Object state, event-time windows, taste vectors, paged pulls and backfills."""

import datetime as dt
import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from encore.operators.objects import contains_value, json_contains, merge_objects, object_concat
from encore.plans import taste, windows
from encore.plans.jobs import IncompletePull, after_backfills, backfilled, full_backfill
from encore.streaming.keyed import KeyedTable
from encore.streaming.state import SnapshotStore


def test_last_non_null_value_per_map_key(spark):
    rows = spark.createDataFrame([
        ("a", {"x": "1", "y": "1"}, 1), ("a", {"x": "2"}, 3), ("a", {"x": None, "z": "9"}, 4), ("a", {"y": "0"}, 0),
        ("b", {}, 1), ("b", None, 2), ("c", {"x": None}, 1)], "k string, ids map<string,string>, s int") \
        .select("k", "ids", F.struct("s").alias("seq"))
    got = {r.k: r.ids for r in merge_objects(rows, "k", "ids").collect()}
    assert got == {"a": {"x": "2", "y": "1", "z": "9"}}
    state = spark.createDataFrame([("a", {"x": "old", "q": "kept"}), ("d", {"x": "5"})], "k string, ids map<string,string>")
    got = {r.k: r.ids for r in merge_objects(rows, "k", "ids", state).collect()}
    assert got == {"a": {"x": "2", "y": "1", "z": "9", "q": "kept"}, "d": {"x": "5"}}


def test_concat_is_right_wins_under_any_policy(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "l map<string,int>, r map<string,int>")
    was = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    assert df.select(object_concat(F.col("l"), F.col("r")).alias("m")).first().m == {"a": 1, "b": 3, "c": 4}
    spark.conf.set("spark.sql.mapKeyDedupPolicy", was)


def contains(o, i):
    if isinstance(o, dict) and isinstance(i, dict):
        return all(k in o and contains(o[k], v) for k, v in i.items())
    if isinstance(o, list) and isinstance(i, list):
        return all(any(contains(y, x) for y in o) for x in i)
    return type(o) is type(i) and o == i


def test_containment_equals_recursion(spark):
    outer = [{"a": 1, "b": {"c": "x", "d": [1, 2, {"e": None}]}}, {"a": "1"}, [], [1, [2, 3], {"k": True}], {}, "x", 1, None]
    inner = [{}, {"a": 1}, {"a": "1"}, {"b": {"c": "x"}}, {"b": {"d": [2]}}, {"b": {"d": [{"e": None}]}}, {"b": {"d": [3]}},
             {"b": {}}, [], [[3]], [{"k": True}], [{"k": False}], "x", 1, {"z": 1}]
    pairs = [(json.dumps(o), json.dumps(i), contains(o, i)) for o in outer for i in inner]
    df = spark.createDataFrame(pairs, "o string, i string, want boolean")
    bad = df.where(json_contains(F.col("o"), F.col("i"), 4) != F.col("want")).collect()
    assert bad == []
    for wanted in inner:
        got = spark.createDataFrame([(json.dumps(o), contains(o, wanted)) for o in outer], "o string, want boolean") \
            .select(contains_value(F.try_parse_json("o"), wanted).alias("got"), "want").collect()
        assert all(r.got == r.want for r in got), wanted
    odd = spark.createDataFrame([(None, "{}"), ("{}", None), ("{broken", "{}")], "o string, i string")
    assert not any(r.c for r in odd.select(json_contains(F.col("o"), F.col("i"), 2).alias("c")).collect())


T0 = dt.datetime(2024, 1, 1, 10)


def plays(spark, minutes):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in minutes], "played_at timestamp_ntz")


def counts(rows):
    return {str(r.start): r.plays for r in rows}


def test_windows_on_a_stream_equal_the_batch_and_late_rows_are_defined(spark):
    root = tempfile.mkdtemp(prefix="encore-windows-", dir="/tmp")
    batches = [[0, 5, 70], [59, 200], [10, 61, 250]]       # the last 10 and 61 come after their windows closed

    seen = {}
    schema = plays(spark, [0]).schema
    for k, b in enumerate(batches):
        plays(spark, b).coalesce(1).write.parquet(f"{root}/in/b={k}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        (windows.plays_per_period(src, "hour", late="60 minutes").writeStream.outputMode("update")
         .foreachBatch(lambda df, i: seen.update(counts(df.collect())))      # the latest row of a window counts
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination())
    on_time = [0, 5, 70, 59, 200, 250]
    assert seen == counts(windows.plays_per_period(plays(spark, on_time), "hour").collect())
    week = windows.plays_per_period(plays(spark, [0, 60 * 24 * 7]), "week").orderBy("start").collect()
    assert [(r.start, r.plays) for r in week] == [(dt.datetime(2024, 1, 1), 1), (dt.datetime(2024, 1, 8), 1)]


def test_taste_is_the_mean_and_copes_with_holes(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [2.0, None]), (4, 2, None), (5, 3, [0.0, 0.0])],
                                 "id int, who int, v array<double>")
    got = {r.id: (r.taste, r.distance) for r in taste.taste_distance(rows, "who", "v", 2).collect()}
    assert got[1][0] == [0.5, 0.5] and math.isclose(got[1][1], 1 - 1 / math.sqrt(2))
    assert got[3][0] == [2.0, None] and got[4][1] is None and got[5][1] is None


def page(user, number, total, title):
    return (json.dumps({"recenttracks": {"@attr": {"user": user, "page": str(number), "totalPages": str(total)}, "track": [
        {"artist": {"#text": user}, "name": title, "date": {"uts": str(1_700_000_000 + number)}}]}}),)


def test_full_pull_needs_every_page(spark):
    pages = [page("u1", 1, 3, "a"), page("u1", 2, 3, "b"), page("u1", 3, 3, "c"), page("u2", 1, 1, "d"), page("u1", 2, 3, "b")]
    frame = spark.createDataFrame(pages, "value string")
    pulled, marks = full_backfill(frame, None, "pulls")
    assert pulled.count() == 5
    (mark,) = marks.collect()
    assert mark.service == "pulls" and str(mark.last_played_at) == "2023-11-14 22:13:23"
    with pytest.raises(IncompletePull, match="page 2 of u1"):
        full_backfill(frame.where("value not like '%\"page\": \"2\"%'"), None, "pulls")


def test_backfills_change_only_their_rows(spark):
    artists = spark.createDataFrame([("1", "a", None, "u1"), ("2", "b", ["x"], None), ("3", "c", [], None)],
                                    "id string, name string, genres array<string>, spotify_uri string")
    genres = spark.createDataFrame([("1", ["rock"], "updated"), ("3", None, "skipped")], "id string, genres array<string>, outcome string")
    ids = spark.createDataFrame([("2", "u2", "updated"), ("3", None, "unresolved")], "id string, spotify_uri string, outcome string")
    assert {r.id: (r.genres, r.spotify_uri) for r in backfilled(artists, genres, ids).collect()} == {
        "1": (["rock"], "u1"), "2": (["x"], "u2")}
    assert after_backfills(artists, genres, ids).count() == 3
    table = KeyedTable(SnapshotStore(spark, tempfile.mkdtemp(prefix="encore-bf-", dir="/tmp")), "artists", "id",
                       artists.schema, buckets=512)
    table.upsert(0, artists)
    assert len(table.upsert(1, backfilled(artists, genres, ids))) <= 2
    assert {r.id: (r.genres, r.spotify_uri) for r in table.read().collect()} == {
        "1": (["rock"], "u1"), "2": (["x"], "u2"), "3": ([], None)}
    assert os.path.isdir(f"{table.root}/data/v=1")
