"""Landed answers and foreign producers of the whole chain (raw pages to recommendations).

The chain's plays are the play-history pages over ``events`` (artist = user),
its raw tracks those of the top-track exploration over the supplier artists.
This module holds what the services answered about them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.sources.bindings import EVENTS_AS_OF
from encore.sources.tables import read_table

# --- Fixed values of the binding ----------------------------------------------
GUEST_SUFFIX = " & guests"      # artists of raw tracks that no artist row has
GUEST_RANK = 4                  # every fourth top track is theirs
IMPORT_SCALE = 8000             # balance that an imported novelty ratio of 1 stands for
# ------------------------------------------------------------------------------

TAGS = "array<struct<name:string,count:int>>"


def _ref(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 22)


def _user(c: str = "user_id") -> Column:
    return F.concat(F.lit("u"), F.col(c).cast("string"))


def with_guests(tracks: DataFrame) -> DataFrame:
    """Raw tracks of which every fourth belongs to an artist without a row."""
    return tracks.withColumn("artist", F.when(F.col("rank") % GUEST_RANK == 0, F.concat("artist", F.lit(GUEST_SUFFIX)))
                             .otherwise(F.col("artist")))


def catalog(spark: SparkSession, sf_dir: str, tracks: DataFrame) -> DataFrame:
    """Track search answers. Plays: whole values of at least 5, for five users
    of six; raw tracks (artist, title, rank): all ranks but 3 and 8."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    plays = ev.filter((F.col("value") >= 5) & (F.col("user_id") % 6 != 5)).select(
        _user().alias("q_artist"), F.col("event_type").alias("q_title"), F.floor("value").cast("int").alias("rank"))
    tops = tracks.filter(F.col("rank") % 5 != 3).select(
        F.col("artist").alias("q_artist"), F.col("title").alias("q_title"), F.col("rank").cast("int").alias("rank"))
    return plays.unionByName(tops).distinct().select(
        "*", F.concat(F.lit("spotify:artist:"), _ref(F.col("q_artist"))).alias("artist_uri"),
        F.concat(F.lit("spotify:track:"),
                 _ref(F.concat_ws("|", "q_artist", "q_title", F.col("rank").cast("string")))).alias("track_uri"))


def artist_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist answers: users but every sixth (every fourth without genres),
    and all suppliers, alone and with guests."""
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("nation"))
    users = read_table(spark, sf_dir, "events").select("user_id").filter(F.col("user_id") % 6 != 4).distinct()
    u = users.join(nat, F.col("user_id") % 25 == F.col("n_nationkey"), "left").select(
        _ref(_user()).alias("artist_ref"),
        F.when((F.col("user_id") % 4 == 0) | F.col("nation").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("nation")).alias("genres"),
        (F.col("user_id") * 7 % 101).cast("int").alias("popularity"))
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    names = F.explode(F.array(F.col("s_name"), F.concat("s_name", F.lit(GUEST_SUFFIX)))).alias("name")
    s = sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "nation", names).select(
        _ref(F.col("name")).alias("artist_ref"), F.array("nation", F.lit("live")).alias("genres"),
        (F.col("s_suppkey") * 3 % 101).cast("int").alias("popularity"))
    return u.unionByName(s)


def track_meta(catalog_rows: DataFrame) -> DataFrame:
    """Track answers: every hit but those of rank 2, 6, 10, ..."""
    return catalog_rows.filter(F.col("rank") % 4 != 2).select(
        F.substring("track_uri", 15, 22).alias("track_ref"), (F.col("rank") % 101).cast("int").alias("popularity"))


def artist_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag answers of every third user: its event types by count."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type").filter(F.col("user_id") % 3 == 0)
    n = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    tags = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("event_type").alias("name"))))
    return n.groupBy("user_id").agg(tags.alias("t")).select(
        _user().alias("artist"),
        F.transform("t", lambda x: F.struct(x["name"].alias("name"), (-x["k"]).alias("count"))).alias("tags"))


def track_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track tags of four users of five: the event type, upper case."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type").filter(F.col("user_id") % 5 != 0).distinct()
    return ev.select(_user().alias("artist"), F.col("event_type").alias("title"),
                     F.array(F.struct(F.upper("event_type").alias("name"), F.lit(None).cast("int").alias("count")))
                     .cast(TAGS).alias("tags"))


def imported_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel events that another producer put into the topic: one per supplier
    (known artists) and customer (unknown ones), with the ratio balance /
    IMPORT_SCALE, which is not always between 0 and 1."""
    sup = read_table(spark, sf_dir, "supplier").select(
        F.lit("import:supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("artist"),
        F.col("s_acctbal").alias("balance"))
    cust = read_table(spark, sf_dir, "customer").select(
        F.lit("import:customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("artist"),
        F.col("c_acctbal").alias("balance"))
    none, at = F.array().cast("array<string>"), F.to_timestamp_ntz(F.lit(EVENTS_AS_OF))
    return sup.unionByName(cust).select(
        F.sha2(F.concat("kind", F.lit("|"), "artist"), 256).alias("track_key"), "artist",
        F.lit(None).cast("string").alias("artist_id"), F.array(F.lit("import")).alias("genres"),
        (F.col("k") % 101).cast("int").alias("artist_popularity"), F.lit(None).cast("int").alias("track_popularity"),
        at.alias("played_at"), F.lit(True).alias("track_is_new"), F.lit(True).alias("artist_is_new"),
        F.array(F.lit("import")).alias("new_genres"), none.alias("known_genres"),
        (F.col("balance") / F.lit(float(IMPORT_SCALE))).alias("genre_novelty_ratio"),
        F.struct(at.alias("ts"), F.col("kind").alias("origin"), F.lit(0).cast("long").alias("page"),
                 F.col("k").cast("long").alias("pos")).alias("seq"))
