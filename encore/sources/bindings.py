"""Binding of the driver's landed tables to the listening-history domain.

``enriched_plays``  one enriched play message per lineitem row
                    (artist = supplier, track = part, played_at = ship date)
``base_artists``    the landed artist dimension (one row per supplier)
``event_plays`` /   a second, time-dense play log over ``events``
``event_artists``   (artist = user, track = event type)

Every message carries ``seq``: a unique, orderable struct that stands for the
arrival order of the reference's message log. Order-dependent operators
compare ``seq`` and never use a global ``row_number``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions.text import case_fold_key, normalize_text, track_key, track_key_of_normalized
from encore.sources.tables import read_table

# --- Fixed values of the binding ----------------------------------------------
# Lifecycle statuses, in their display rank.
STATUSES = ["TRACKED", "FOLLOWING", "PUBLISHED", "BLACKLISTED"]
# Artist discovery sources assigned to landed artists (null and '' included).
ARTIST_SOURCES = [None, "", "LASTFM_SIMILAR", "LASTFM_HISTORY", "ONBOARDING"]
# "now" of the play log built on lineitem (after the last ship date).
PLAYS_AS_OF = "2001-12-01 00:00:00"
# "now" of the play log built on events.
EVENTS_AS_OF = "2024-01-31 00:00:00"
# ------------------------------------------------------------------------------


def _pick(values, index_col):
    """values[index] as a CASE expression (small fixed lists only)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(index_col == i, lit) if expr is None else expr.when(index_col == i, lit)
    return expr


def spotify_uri(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"spotify:{kind}:"), F.substring(F.sha2(key.cast("string"), 256), 1, 22))


def enriched_plays(spark: SparkSession, sf_dir: str, fits: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """lineitem x part x supplier as enriched play messages. A fixed share of
    the orders carries the messages that must not pass: without a track key
    (order key divisible by 97), without a title (101), not enriched (89).

    ``fits`` counts the parts and suppliers: those that fit go to the log. If
    neither do, suppliers are met first, whose columns are the narrower ones in
    the second shuffle. A partition's plays of one track then stand together, so
    that its key and texts take little room where the log is landed."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    # text normalisation runs once per part / supplier, before the join; the URIs
    # are hashes of keys the line has, which would only widen what is shuffled and sorted
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size") \
        .withColumn("p_norm", normalize_text("p_name"))
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal") \
        .withColumn("s_norm", normalize_text("s_name"))
    met = [(part, li.l_partkey == part.p_partkey), (sup, li.l_suppkey == sup.s_suppkey)]
    if fits is not None:
        small = {id(d): fits(d) for d, _ in met}
        met = [(F.broadcast(d) if small[id(d)] else d, on) for d, on in (met if small[id(sup)] else met[::-1])]
    df = li
    for d, on in met:
        df = df.join(d, on)
    if fits is not None:
        df = df.sortWithinPartitions(case_fold_key("s_name"), "p_norm")
    source = F.when(F.col("l_returnflag") == "R", F.lit("spotify")).otherwise(F.lit("lastfm"))
    return df.select(
        F.struct(F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber",
                 "l_partkey", "l_suppkey").alias("seq"),
        F.when(F.col("l_orderkey") % 97 != 0, track_key_of_normalized("s_norm", "p_norm")).alias("track_key"),
        F.col("s_name").alias("artist"),
        case_fold_key(F.col("s_name")).alias("artist_key"),
        F.when(F.col("l_orderkey") % 101 != 0, F.col("p_name")).alias("title"),
        spotify_uri("artist", F.col("s_suppkey")).alias("artist_id"),
        spotify_uri("track", F.col("p_partkey")).alias("track_id"),
        F.array(F.lower("p_type"), F.lower("p_brand")).alias("genres"),
        F.pmod(F.floor("s_acctbal").cast("int"), F.lit(101)).alias("artist_popularity"),
        F.col("p_size").alias("track_popularity"),
        source.alias("source"),
        (source == "lastfm").alias("played"),
        F.col("l_shipdate").alias("played_at"),
        F.when(F.col("l_orderkey") % 89 == 0, F.lit("pending")).otherwise(F.lit("spotify")).alias("enrichment_source"),
        (F.col("l_orderkey") % 89 == 0).alias("pending_enrichment"),
    )


def base_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed artist dimension: one row per supplier, counters at zero."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    origin = sup.select(F.col("s_suppkey").alias("o_key"), F.col("s_name").alias("o_name"))
    joined = sup.join(origin, (F.col("s_suppkey") >= 10) & (F.col("o_key") == F.floor(F.col("s_suppkey") / 10)),
                      "left")
    as_of = F.to_timestamp_ntz(F.lit(PLAYS_AS_OF))
    nation = F.col("s_nationkey")
    uri = spotify_uri("artist", F.col("s_suppkey"))
    mbid = F.substring(F.sha2(F.concat(F.lit("mbid"), F.col("s_suppkey").cast("string")), 256), 1, 36)
    return joined.select(
        F.sha2(F.lower("s_name"), 256).alias("id"),
        F.col("s_name").alias("name"),
        F.lower("s_name").alias("name_key"),
        _pick(STATUSES, F.pmod(F.col("s_suppkey"), F.lit(4))).alias("status"),
        (F.col("s_acctbal") > 5000).alias("high_priority"),
        F.when(F.col("o_name").isNotNull(), F.sha2(F.lower("o_name"), 256)).alias("origin_artist_id"),
        _pick(ARTIST_SOURCES, F.pmod(F.col("s_suppkey"), F.lit(5))).alias("source"),
        F.when(F.pmod(nation, F.lit(3)) != 0, as_of - F.make_interval(days=nation)).alias("last_explored_at"),
        F.when(F.pmod(nation, F.lit(2)) == 1,
               as_of - F.make_interval(hours=nation * 2)).alias("last_similar_explored_at"),
        F.when(F.pmod(F.col("s_suppkey"), F.lit(7)) != 0, uri).alias("spotify_uri"),
        F.when(F.pmod(F.col("s_suppkey"), F.lit(2)) == 0, mbid).alias("lastfm_mbid"),
    )


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as play messages: artist = user, title = event type."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    artist = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return ev.select(
        F.struct(F.col("ts"), F.col("event_id")).alias("seq"),
        track_key(artist, F.col("event_type")).alias("track_key"),
        artist.alias("artist"),
        case_fold_key(artist).alias("artist_key"),
        F.col("event_type").alias("title"),
        F.lit(None).cast("string").alias("artist_id"),
        F.lit(None).cast("string").alias("track_id"),
        F.array(F.lower("event_type")).alias("genres"),
        F.get_json_object("props", "$.k").cast("int").alias("artist_popularity"),
        F.lit(None).cast("int").alias("track_popularity"),
        F.lit("lastfm").alias("source"),
        F.lit(True).alias("played"),
        F.col("ts").alias("played_at"),
        F.lit("lastfm").alias("enrichment_source"),
        F.lit(False).alias("pending_enrichment"),
    )


# ---------------------------------------------------------------- enrichment inputs
def normalized_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized (not yet enriched) play messages. Parts smaller than size 5
    were not found by the id search (no ids); seventh order lines carry a
    malformed artist URI (a track URI), which the enricher must reject."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size") \
        .withColumn("p_norm", normalize_text("p_name"))
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name") \
        .withColumn("s_norm", normalize_text("s_name"))
    df = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    found = F.col("p_size") >= 5
    artist_id = (F.when(~found, F.lit(None).cast("string"))
                 .when(F.col("l_linenumber") == 7, spotify_uri("track", F.col("s_suppkey")))
                 .otherwise(spotify_uri("artist", F.col("s_suppkey"))))
    return df.select(
        F.struct(F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber",
                 "l_partkey", "l_suppkey").alias("seq"),
        track_key_of_normalized("s_norm", "p_norm").alias("track_key"),
        F.col("s_name").alias("artist"), F.col("p_name").alias("title"),
        artist_id.alias("artist_id"),
        F.when(found, spotify_uri("track", F.col("p_partkey"))).alias("track_id"),
        F.col("l_shipdate").alias("played_at"))


def artist_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist service answers: suppliers with a non-negative balance. Nations
    below 5 answer with an empty genre list."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = sup.filter(F.col("s_acctbal") >= 0).join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select(
        F.substring(F.sha2(F.col("s_suppkey").cast("string"), 256), 1, 22).alias("artist_ref"),
        F.when(F.col("s_nationkey") < 5, F.array().cast("array<string>"))
        .otherwise(F.array(F.lower("n_name"))).alias("genres"),
        F.pmod(F.floor("s_acctbal").cast("int"), F.lit(101)).alias("popularity"))


def track_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track service answers: parts up to size 45."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return part.filter(F.col("p_size") <= 45).select(
        F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 22).alias("track_ref"),
        F.col("p_size").alias("popularity"))


def artist_tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag service answers per artist: part types the supplier's plays carry,
    with play counts, in service order (count desc, name). Bounded by the
    number of distinct types per supplier."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    counts = (li.join(part, li.l_partkey == part.p_partkey)
              .groupBy("l_suppkey", "p_type").agg(F.count(F.lit(1)).cast("int").alias("n")))
    per = counts.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("n")).alias("k"), F.col("p_type").alias("name"), F.col("n").alias("count")))).alias("t"))
    return (per.join(sup, per.l_suppkey == sup.s_suppkey)
            .select(F.col("s_name").alias("artist"),
                    F.transform("t", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))
                    .alias("tags")))


def track_tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track tags per (artist, title): brand then type of the lowest part key
    with that name supplied by the artist (names only). The lowest key is a
    hash aggregation on (supplier, part name); the part row is joined after."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    first = (li.join(part.select("p_partkey", "p_name"), li.l_partkey == part.p_partkey)
             .groupBy("l_suppkey", "p_name").agg(F.min("p_partkey").alias("k")))
    tags = F.array(F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("int").alias("count")),
                   F.struct(F.col("p_type").alias("name"), F.lit(None).cast("int").alias("count")))
    return (first.join(part.select(F.col("p_partkey").alias("k"), "p_brand", "p_type"), "k")
            .join(sup, first.l_suppkey == sup.s_suppkey)
            .select(F.col("s_name").alias("artist"), F.col("p_name").alias("title"), tags.alias("tags")))


# ---------------------------------------------------------------- lifecycle inputs
# --- Fixed values: status decided for each order priority (5-LOW is invalid) --
PRIORITY_DECISIONS = [("1-URGENT", "FOLLOWING"), ("2-HIGH", "PUBLISHED"), ("3-MEDIUM", "TRACKED"),
                      ("4-NOT SPECIFIED", "BLACKLISTED"), ("5-LOW", "ARCHIVED")]
# ------------------------------------------------------------------------------


def status_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curator decisions: every order decides on the artist (supplier) of its
    first line; the status follows the order priority; decided at the order
    date, order key breaking ties."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey") \
        .filter(F.col("l_linenumber") == 1)
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    status = None
    for prio, st in PRIORITY_DECISIONS:
        status = F.when(F.col("o_orderpriority") == prio, F.lit(st)) if status is None else \
            status.when(F.col("o_orderpriority") == prio, F.lit(st))
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(sup, li.l_suppkey == sup.s_suppkey)
    return j.select(F.sha2(F.lower("s_name"), 256).alias("artist_id"), status.alias("status"),
                    F.col("o_orderdate").alias("decided_at"), F.col("o_orderkey").alias("tie"))


def artist_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist search answers (name -> artist URI) where the service answered."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return sup.filter(F.col("s_acctbal") >= 0).select(F.col("s_name").alias("name"),
                                                      spotify_uri("artist", F.col("s_suppkey")).alias("uri"))


def track_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed track-search answers for (artist, title) queries over the event
    log: every (user, event type, whole value) with value >= 5 is one hit,
    ranked by the value; the hit carries artist and track URIs."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    hits = ev.filter(F.col("value") >= 5).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("q_artist"),
        F.col("event_type").alias("q_title"),
        F.floor("value").cast("int").alias("rank"),
        "user_id").distinct()
    return hits.select(
        "q_artist", "q_title", "rank",
        spotify_uri("artist", F.col("user_id")).alias("artist_uri"),
        F.concat(F.lit("spotify:track:"),
                 F.substring(F.sha2(F.concat_ws("|", F.col("q_artist"), F.col("q_title"),
                                                F.col("rank").cast("string")), 256), 1, 22)).alias("track_uri"))
