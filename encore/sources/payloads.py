"""Landed JSON payloads of the external services and their readers.

Writers (``*_payloads``) turn driver tables into the JSON documents the
services return, so the readers run on realistic nested text; readers
(``read_*``) are the reference's parsing rules as Spark JSON functions with
explicit schemas (never inferred).

S1  read_play_pages      page JSON -> tracks; a page with one track holds an
                          object instead of an array
S2  raw_plays            drop now-playing and undated tracks; epoch -> UTC;
                          "" mbid -> null; keep the raw JSON
S10 read_tag_payload     tag JSON -> array<struct<name,count>>, errors -> []
S11 read_similar_payload similar JSON -> (position, name, mbid, match)
S12 read_top_tracks      top-track JSON -> tracks with a first artist
S13 read_followed        follow pages -> distinct lower-cased names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.sources.bindings import spotify_uri
from encore.sources.tables import read_table

# --- Fixed values: page size of the play-history service ---------------------
PLAYS_PER_PAGE = 200
# entries of one answer of the similar-artist service
SIMILAR_PER_ANSWER = 10
# ------------------------------------------------------------------------------

PLAY_TRACK = T.StructType([
    T.StructField("@attr", T.StructType([T.StructField("nowplaying", T.StringType())])),
    T.StructField("artist", T.StructType([T.StructField("#text", T.StringType()),
                                          T.StructField("mbid", T.StringType())])),
    T.StructField("name", T.StringType()),
    T.StructField("mbid", T.StringType()),
    T.StructField("date", T.StructType([T.StructField("uts", T.StringType()),
                                        T.StructField("#text", T.StringType())])),
])
TAG = T.StructType([T.StructField("name", T.StringType()), T.StructField("count", T.StringType())])
SIMILAR = T.StructType([T.StructField("name", T.StringType()), T.StructField("mbid", T.StringType()),
                        T.StructField("match", T.StringType())])
TOP_TRACK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("artists", T.ArrayType(T.StructType([T.StructField("id", T.StringType()),
                                                       T.StructField("name", T.StringType())])))])


# ---------------------------------------------------------------- play pages
def play_page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as paged play-history JSON: user u<id>, pages of at most 200
    events (by event id block), numbered from the newest, with their number in
    all; each user's latest event is now playing and carries no date."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    latest = ev.groupBy("user_id").agg(F.max("event_id").alias("_last"))
    e = ev.join(latest, "user_id")
    now_playing = F.col("event_id") == F.col("_last")
    track = F.struct(
        F.when(now_playing, F.struct(F.lit("true").alias("nowplaying"))).alias("@attr"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("#text"),
                 F.lit("").alias("mbid")).alias("artist"),
        F.col("event_type").alias("name"),
        F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0,
               F.substring(F.sha2(F.col("event_type"), 256), 1, 36)).otherwise(F.lit("")).alias("mbid"),
        F.when(~now_playing, F.struct(F.unix_timestamp("ts").cast("string").alias("uts"),
                                      F.date_format("ts", "dd MMM yyyy, HH:mm").alias("#text"))).alias("date"))
    blocks = (e.groupBy("user_id", F.floor(F.col("event_id") / PLAYS_PER_PAGE).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("event_id")).alias("k"), track.alias("t"))))
                   .alias("tracks")))
    user = Window.partitionBy("user_id")
    pages = blocks.withColumn("page", F.row_number().over(user.orderBy(F.col("block").desc()))).withColumn(
        "total", F.count(F.lit(1)).over(user))
    tracks = F.transform("tracks", lambda x: x["t"])
    body = F.when(F.size("tracks") == 1, F.to_json(tracks[0])).otherwise(F.to_json(tracks))
    attr = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
                              F.col("page").cast("string").alias("page"),
                              F.col("total").cast("string").alias("totalPages")))
    return pages.select(
        F.concat(F.lit('{"recenttracks":{"@attr":'), attr, F.lit(',"track":'), body, F.lit("}}")).alias("value"))


def read_play_pages(pages: DataFrame) -> DataFrame:
    """One row per track of every page (object-or-array coerced): the
    typed track ``t``, its whole text ``raw`` (fields outside the type
    included) and the page count the service reports."""
    body = F.get_json_object("value", "$.recenttracks.track")
    as_array = F.when(F.ltrim(body).startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    texts = F.transform(F.from_json(as_array, T.ArrayType(T.VariantType())), lambda v: F.to_json(v))
    total = F.get_json_object("value", "$.recenttracks['@attr'].totalPages").try_cast("int")
    page = F.get_json_object("value", "$.recenttracks['@attr'].page").try_cast("long")
    each = F.posexplode(F.arrays_zip(F.from_json(as_array, T.ArrayType(PLAY_TRACK)).alias("t"), texts.alias("raw")))
    return pages.select(total.alias("total_pages"), page.alias("page"), each.alias("pos", "e")).select(
        "e.t", "e.raw", "total_pages", "page", "pos")


def missing_pages(pages: DataFrame) -> DataFrame:
    """(user, page) of every page up to the reported number of pages that did not arrive."""
    attr = lambda name: F.get_json_object("value", f"$.recenttracks['@attr'].{name}")
    seen = pages.select(attr("user").alias("user"), attr("page").try_cast("int").alias("page"),
                        attr("totalPages").try_cast("int").alias("total"))
    users = seen.groupBy("user").agg(F.max("total").alias("total"), F.count_distinct("page").alias("n"))
    short = users.where((F.col("total") > 0) & (F.col("n") < F.col("total")))
    wanted = short.select("user", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("page"))
    return wanted.join(seen.select("user", "page"), ["user", "page"], "left_anti")


def raw_plays(tracks: DataFrame) -> DataFrame:
    """Now-playing and undated tracks produce no play. ``seq`` orders the
    plays: by time, then artist, page and place (pages list the newest first)."""
    t = F.col("t")
    keep = (F.coalesce(t["@attr"]["nowplaying"], F.lit("")) != "true") & t["date"].isNotNull() & \
        t["date"]["uts"].isNotNull()
    out = tracks.filter(keep)
    mbid = F.nullif(t["mbid"], F.lit(""))
    # epoch seconds -> UTC wall-clock time (the session zone is UTC)
    played_at = F.timestamp_seconds(t["date"]["uts"].cast("long")).cast("timestamp_ntz")
    return out.select(
        F.lit("lastfm").alias("source"),
        t["artist"]["#text"].alias("artist"),
        t["name"].alias("title"),
        played_at.alias("played_at"),
        F.when(mbid.isNotNull(), F.create_map(F.lit("lastfm_mbid"), mbid))
        .otherwise(F.create_map().cast("map<string,string>")).alias("external_ids"),
        F.col("raw"),
        F.struct(played_at.alias("ts"), t["artist"]["#text"].alias("origin"), (-F.col("page")).alias("page"),
                 (-F.col("pos")).cast("long").alias("pos")).alias("seq"))


# ---------------------------------------------------------------- tags
def tag_payloads(artist_tags: DataFrame) -> DataFrame:
    """Artist tag answers as JSON (counts as strings, like the service)."""
    tags = F.transform("tags", lambda x: F.struct(x["name"].alias("name"), x["count"].cast("string").alias("count")))
    return artist_tags.select("artist", F.to_json(F.struct(F.struct(tags.alias("tag")).alias("toptags")))
                              .alias("payload"))


def read_tag_payload(payload) -> F.Column:
    """Tag JSON -> array<struct<name:string,count:int>>; an error object,
    a missing list or unparsable text -> []."""
    c = F.col(payload) if isinstance(payload, str) else payload
    tags = F.from_json(F.get_json_object(c, "$.toptags.tag"), T.ArrayType(TAG))
    typed = F.transform(tags, lambda t: F.struct(t["name"].alias("name"), t["count"].try_cast("int").alias("count")))
    return F.when(F.get_json_object(c, "$.error").isNotNull(), F.array().cast("array<struct<name:string,count:int>>")) \
        .otherwise(F.coalesce(typed, F.array().cast("array<struct<name:string,count:int>>")))


# ---------------------------------------------------------------- similar artists
def similar_payloads(spark: SparkSession, sf_dir: str, limit: int = SIMILAR_PER_ANSWER) -> DataFrame:
    """Similar-artist answers per supplier (keys 0, 1, 2, ...): every part is
    dealt to the supplier of its key modulo their number, in answers of
    ``limit`` entries. Names vary in case (so case-folded names collide), mbid
    from the brand (null for sizes divisible by 3); the last entry of an answer
    reuses the next supplier's mbid (already known for even keys)."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    n = sup.select(F.count(F.lit(1))).scalar()
    nth = F.floor(F.col("p_partkey") / n)
    dealt = part.withColumns({"s_suppkey": F.col("p_partkey") % n, "answer": F.floor(nth / limit),
                              "position": (nth % limit + 1).cast("int")})
    j = dealt.join(sup, "s_suppkey")
    k = F.pmod(F.col("position"), F.lit(3))
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.initcap("p_name")).otherwise(F.col("p_name"))
    mbid = (F.when(F.col("position") == limit,
                   F.substring(F.sha2(F.concat(F.lit("mbid"), (F.col("s_suppkey") + 1).cast("string")), 256), 1, 36))
            .when(F.pmod(F.col("p_size"), F.lit(3)) == 0, F.lit(None).cast("string"))
            .otherwise(F.substring(F.sha2(F.col("p_brand"), 256), 1, 36)))
    entry = F.struct(name.alias("name"), mbid.alias("mbid"),
                     F.format_number(F.lit(1.0) - F.col("position") / 20.0, 2).alias("match"))
    per = j.groupBy("s_name", "answer").agg(
        F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))).alias("l"))
    attr = F.struct(F.col("answer").cast("string").alias("page"))
    return per.select(F.col("s_name").alias("artist"),
                      F.to_json(F.struct(F.struct(F.transform("l", lambda x: x["e"]).alias("artist"),
                                                  attr.alias("@attr")).alias("similarartists"))).alias("payload"))


def read_similar_payload(payloads: DataFrame) -> DataFrame:
    """(artist, position, name, mbid or null, match) in list order, that
    of several answers page by page; entries without a name are dropped."""
    page = F.coalesce(F.get_json_object("payload", "$.similarartists['@attr'].page").try_cast("int"), F.lit(0))
    arr = F.from_json(F.get_json_object("payload", "$.similarartists.artist"), T.ArrayType(SIMILAR))
    ex = payloads.select("artist", page.alias("page"), F.posexplode(arr).alias("pos", "s"))
    return (ex.filter(F.col("s.name").isNotNull() & (F.col("s.name") != ""))
            .select("artist", (F.col("page") * SIMILAR_PER_ANSWER + F.col("pos") + 1).alias("position"),
                    F.col("s.name").alias("name"), F.nullif(F.col("s.mbid"), F.lit("")).alias("mbid"),
                    F.col("s.match").try_cast("double").alias("match")))


# ---------------------------------------------------------------- top tracks
def top_track_payloads(spark: SparkSession, sf_dir: str, top_n: int = 10) -> DataFrame:
    """Top tracks per supplier: its ``top_n`` most played parts (count desc,
    part key); parts smaller than size 3 come back without artists."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    counts = li.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy(F.col("n").desc(), F.col("l_partkey"))
    top = counts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top_n)
    j = top.join(part, top.l_partkey == part.p_partkey).join(sup, top.l_suppkey == sup.s_suppkey)
    artists = F.when(F.col("p_size") < 3, F.array().cast("array<struct<id:string,name:string>>")).otherwise(
        F.array(F.struct(F.substring(F.sha2(F.col("s_suppkey").cast("string"), 256), 1, 22).alias("id"),
                         F.col("s_name").alias("name"))))
    trk = F.struct(F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 22).alias("id"),
                   F.col("p_name").alias("name"), artists.alias("artists"))
    per = j.groupBy("s_name").agg(F.sort_array(F.collect_list(F.struct("rk", trk.alias("t")))).alias("l"))
    return per.select(F.col("s_name").alias("artist"),
                      F.to_json(F.struct(F.transform("l", lambda x: x["t"]).alias("tracks"))).alias("payload"))


def read_top_tracks(payloads: DataFrame) -> DataFrame:
    """Tracks with at least one artist; the first artist is kept."""
    arr = F.from_json(F.get_json_object("payload", "$.tracks"), T.ArrayType(TOP_TRACK))
    ex = payloads.select("artist", F.posexplode(arr).alias("pos", "t"))
    return (ex.filter(F.size("t.artists") > 0)
            .select("artist", (F.col("pos") + 1).alias("rank"), F.col("t.id").alias("track_ref"),
                    F.col("t.name").alias("title"), F.get("t.artists", 0)["id"].alias("track_artist_ref"),
                    F.get("t.artists", 0)["name"].alias("track_artist")))


# ---------------------------------------------------------------- follows
def followed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed artists (cursor pages of 50 names): suppliers with a negative
    balance, upper-cased, plus one empty name per page."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    f = sup.filter(F.col("s_acctbal") < 0)
    pages = f.groupBy(F.floor(F.col("s_suppkey") / 50).alias("cursor")).agg(
        F.sort_array(F.collect_list(F.upper("s_name"))).alias("names"))
    items = F.transform(F.concat("names", F.array(F.lit(""))), lambda n: F.struct(n.alias("name")))
    return pages.select(F.to_json(F.struct(F.struct(items.alias("items"), F.col("cursor").cast("string")
                                                    .alias("cursor")).alias("artists"))).alias("payload"))


def read_followed(payloads: DataFrame) -> DataFrame:
    """The set of followed names, lower-cased, empties dropped."""
    names = F.from_json(F.get_json_object("payload", "$.artists.items"),
                        T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))
    return (payloads.select(F.explode(names).alias("i"))
            .select(F.lower(F.col("i.name")).alias("name"))
            .filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct())
