"""The log of messages is not shuffled for lookups that fit an executor, and
what a landed table shuffled does not stay on disk."""

import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from encore.operators.joins import fits, light
from encore.operators.ordered import first_seen_history, novelty_signals
from encore.plans.build import build_state, empty_artists
from encore.plans.stages import discovery_batch
from encore.sources import bindings
from test_stages import MSG_SCHEMA, msg

T0 = dt.datetime(1995, 1, 1)


@pytest.fixture()
def no_broadcast(spark):
    """Joins shuffle, as they do where Spark does not know a table to be small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """300 plays of 12 parts by 4 suppliers, two of one name; each comes in four orders."""
    to = str(tmp_path_factory.mktemp("plays"))
    lines = [(i, 1, i % 12, i % 4, "R" if i % 7 == 0 else "N", T0 + dt.timedelta(days=i // 4)) for i in range(1, 301)]
    frames = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, "
                            "l_shipdate timestamp_ntz"),
        "part": ([(k, f"name {k % 9}", f"TYPE {k % 5}", f"Brand {k % 3}", k) for k in range(12)],
                 "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "supplier": ([(k, f"Supplier {k % 3}", k % 2, 100.0 * k) for k in range(4)],
                     "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{to}/{name}.parquet")
    return to


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def local_shuffles(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}


def test_fits_counts_rows_and_texts(spark):
    df = spark.createDataFrame([("ä" * 100, ["b" * 50, None], (1, "c")), (None, None, None)],
                               "s string, l array<string>, t struct<i:int,u:string>")
    size = 2 * 32 + (200 + 8 + 8) + (16 + 50 + 8 + 8 + 16) + 2 * (8 + 8 + 8) + 1
    assert fits(df, size) and not fits(df, size - 1)
    assert fits(df.limit(0), 0)
    assert "BroadcastExchange" in plan(df.join(light(df.select("s").distinct()), "s"))


def test_the_plays_build_leaves_no_shuffle_on_disk(spark, no_broadcast, tables):
    before = local_shuffles(spark)
    st = build_state(spark, tables, "plays")
    end = time.time() + 10
    while (left := local_shuffles(spark) - before) and time.time() < end:
        time.sleep(0.1)         # Spark removes them in the background
    # the few that stay are of counts, which send one row a task
    assert sum(os.path.getsize(f) for f in left if os.path.exists(f) and f.endswith(".data")) < 20_000
    for df in (st.messages, st.history, st.artists, st.novelty, st.scored, st.recommendations, st.dlq):
        assert all(f.endswith(".zstd.parquet") for f in df.inputFiles())
    assert st.messages.count() == 300 and st.artists.count() == 4


def test_plays_are_the_same_whatever_fits(spark, no_broadcast, tables):
    want = rows_of(bindings.enriched_plays(spark, tables))
    assert len(want) == 300
    for answer in (lambda df: True, lambda df: False, lambda df: "s_suppkey" in df.columns):
        assert rows_of(bindings.enriched_plays(spark, tables, answer)) == want
    one = bindings.enriched_plays(spark, tables, fits)
    assert "SortMergeJoin" not in plan(one)


def test_novelty_flags_do_not_shuffle_the_log(spark, no_broadcast, tables):
    flags = entry.queries()["novelty_flags"](spark, tables)
    assert "SortMergeJoin" not in plan(flags)
    st = build_state(spark, tables, "plays")
    assert sum(r.emitted for r in flags.collect()) == st.novelty.count() > 0


def odd_messages(spark):
    """Repeats, unplayed plays before a track's first row, messages of one seq, missing genres and keys."""
    rows = [msg(i, f"k{i % 5}", "A" if i % 3 else "B", "t", ["pop", "", None, f"g{i % 4}"], played=i % 6 != 1) for i in range(1, 40)]
    rows += [msg(50, "n1", "C", "t", ["fresh", "fresh"])] * 2 + [msg(51, "n2", "C", "t", None)]
    rows += [msg(60, None, "C", "t", ["x"]), msg(61, "n3", "D", None, ["y"]), msg(62, "n4", "D", "t", ["z"], pending=True),
             msg(63, "n5", "E", "t", ["unheard"], played=False)]
    return spark.createDataFrame(rows, MSG_SCHEMA).withColumn("seq", F.struct(F.col("played_at").alias("ts"), "seq.i"))


def test_a_batch_is_the_same_whether_lookups_fit(spark, no_broadcast, tmp_path):
    m, plans, sizes = odd_messages(spark), {}, {}

    def landing(kind):
        def land(name, df):
            plans[kind, name] = plan(df)
            df.write.parquet(f"{tmp_path}/{kind}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{kind}/{name}")
            sizes[kind, name] = out.count()
            return out
        return land

    plain = discovery_batch(m, empty_artists(spark), land=landing("plain"))
    counted = discovery_batch(m, empty_artists(spark), land=landing("counted"), fits=fits)
    none = discovery_batch(m, empty_artists(spark), land=landing("none"), fits=lambda df: False)
    for name in ("history", "artists", "novel_events", "scored", "recommendations", "dlq"):
        want = rows_of(getattr(plain, name))
        assert want and rows_of(getattr(counted, name)) == want and rows_of(getattr(none, name)) == want, name
    # messages of one seq list their new genres together
    assert [list(r.new_genres) for r in counted.novel_events.filter("track_key = 'n1'").collect()] == [["fresh"] * 4] * 2
    assert "SortMergeJoin" in plans["none", "novel_events"]
    for name in ("history", "novel_events", "genre_hits"):
        assert "SortMergeJoin" not in plans["counted", name], name


def test_rows_of_new_genres_grow_with_tracks_not_plays(spark):
    rows = [msg(i, "k", "A", "t", ["pop", "rock"], played=False) for i in range(1, 41)] + [msg(41, "k", "A", "t", ["pop", "rock"])]
    m, hits = spark.createDataFrame(rows, MSG_SCHEMA), []

    def land(name, df):
        hits.append(df.collect())
        return df

    out = novelty_signals(m, first_seen_history(m), land=land)
    assert out.filter(F.size("new_genres") == 2).count() == 41
    assert [len(h) for h in hits] == [1]
