"""Enrichment (T1 enrich_chain / J2 enrich_join) against landed lookup tables.

External services become tables: a row in ``artist_meta`` / ``track_meta``
means the service answered for that id; tag tables hold the tag lists the
tag service would return. The chain per message:

(a) both ids present and valid, and both meta rows exist -> genres from the
    artist meta (may be empty), popularities, source ``spotify``;
(b) ids present but no answer -> artist tags, else track tags -> source
    ``lastfm``; no tags -> ``pending``;
(c) no ids -> ``pending``.
Then, when genres are still empty, artist tags fill them without changing
source or pending. All four lookups are left equi-joins on de-duplicated keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values of the tag service -----------------------------------------
MAX_TAGS = 5               # tags kept from the top of a tag list
MIN_TAG_COUNT = 10         # enrichment: minimum count of an artist tag
BACKFILL_MIN_TAG_COUNT = 15  # genre backfill job: minimum count
# ------------------------------------------------------------------------------


def entity_id(uri, kind: str) -> F.Column:
    """The id of ``spotify:{kind}:<10-30 alphanumerics>``, else null."""
    c = F.col(uri) if isinstance(uri, str) else uri
    return F.nullif(F.regexp_extract(c, f"^spotify:{kind}:([A-Za-z0-9]{{10,30}})$", 1), F.lit(""))


def bare_entity_id(value) -> F.Column:
    """A URI or a bare base-62 id (any length >= 1) -> the id, else null."""
    c = F.col(value) if isinstance(value, str) else value
    stripped = F.regexp_replace(c, "^spotify:[a-z]+:", "")
    return F.when(stripped.rlike("^[A-Za-z0-9]+$"), stripped)


def enrichment_artist_tags(tags) -> F.Column:
    """O7/F15 enrichment form: first five tags, then count >= 10, lower-cased."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.transform(F.filter(F.slice(c, 1, MAX_TAGS),
                                lambda t: t["name"].isNotNull() & (t["name"] != "") &
                                (F.coalesce(t["count"], F.lit(0)) >= MIN_TAG_COUNT)),
                       lambda t: F.lower(t["name"]))


def backfill_artist_tags(tags) -> F.Column:
    """O7 backfill form: count >= 15 first, then the first five, lower-cased."""
    c = F.col(tags) if isinstance(tags, str) else tags
    kept = F.filter(c, lambda t: t["name"].isNotNull() & (t["name"] != "") & t["count"].isNotNull() &
                    (t["count"] >= BACKFILL_MIN_TAG_COUNT))
    return F.transform(F.slice(kept, 1, MAX_TAGS), lambda t: F.lower(t["name"]))


def track_tag_names(tags) -> F.Column:
    """Track tags: first five names, case kept, no count threshold."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.filter(F.transform(F.slice(c, 1, MAX_TAGS), lambda t: t["name"]),
                    lambda n: n.isNotNull() & (n != ""))


@dataclass
class Answers:
    """The services' answers as lookup tables, one row per key."""

    artists: DataFrame
    tracks: DataFrame
    artist_tags: DataFrame
    track_tags: DataFrame


def answers(artist_meta: DataFrame, track_meta: DataFrame, artist_tags: DataFrame, track_tags: DataFrame) -> Answers:
    """``artist_meta(artist_ref, genres, popularity)``, ``track_meta(track_ref,
    popularity)``, ``artist_tags(artist, tags)``, ``track_tags(artist, title, tags)``
    where tags are arrays of struct<name,count> in service order."""
    am = (artist_meta.groupBy(F.col("artist_ref").alias("_aref"))
          .agg(F.min(F.struct(F.col("popularity").alias("p"), F.col("genres").alias("g"))).alias("_am"))
          .select("_aref", F.lit(True).alias("_ahit"), F.col("_am.g").alias("_meta_genres"),
                  F.col("_am.p").alias("_apop")))
    tm = (track_meta.groupBy(F.col("track_ref").alias("_tref"))
          .agg(F.min(F.col("popularity")).alias("_tpop")).withColumn("_thit", F.lit(True)))
    # of several answers for a key the least list counts
    at = (artist_tags.groupBy(F.col("artist").alias("_at_artist"))
          .agg(F.min(enrichment_artist_tags("tags")).alias("_atags")))
    tt = (track_tags.groupBy(F.col("artist").alias("_tt_artist"), F.col("title").alias("_tt_title"))
          .agg(F.min(track_tag_names("tags")).alias("_ttags")))
    return Answers(am, tm, at, tt)


def enrich(normalized: DataFrame, artist_meta: DataFrame, track_meta: DataFrame,
           artist_tags: DataFrame, track_tags: DataFrame, land=lambda df, name: df) -> DataFrame:
    """T1 over raw answers (see ``answers``); ``land`` writes each lookup table."""
    a = answers(artist_meta, track_meta, artist_tags, track_tags)
    return enrich_from(normalized, Answers(land(a.artists, "artist-answers"), land(a.tracks, "track-answers"),
                                           land(a.artist_tags, "artist-tags"), land(a.track_tags, "track-tags")))


def enrich_from(normalized: DataFrame, found: Answers) -> DataFrame:
    """T1 over lookup tables; on a stream four stream-static left joins."""
    ids = (F.col("artist_id").isNotNull() & (F.col("artist_id") != "") &
           F.col("track_id").isNotNull() & (F.col("track_id") != ""))
    j = (normalized
         .withColumn("_aref", entity_id("artist_id", "artist"))
         .withColumn("_tref", entity_id("track_id", "track"))
         .withColumn("_ids", ids)
         # the widest table first, while the messages are still narrow
         .join(found.tracks, "_tref", "left").join(found.artists, "_aref", "left")
         .join(found.artist_tags, F.col("artist") == F.col("_at_artist"), "left")
         .join(found.track_tags, (F.col("artist") == F.col("_tt_artist")) & (F.col("title") == F.col("_tt_title")), "left"))
    ids = F.col("_ids")
    answered = ids & F.col("_ahit").isNotNull() & F.col("_thit").isNotNull()
    atags = F.coalesce(F.col("_atags"), F.array().cast("array<string>"))
    ttags = F.coalesce(F.col("_ttags"), F.array().cast("array<string>"))
    fallback = F.when(F.size(atags) > 0, atags).when(F.size(ttags) > 0, ttags)
    genres = (F.when(answered, F.coalesce(F.col("_meta_genres"), F.array().cast("array<string>")))
              .when(ids, fallback))
    source = (F.when(answered, F.lit("spotify"))
              .when(ids & fallback.isNotNull(), F.lit("lastfm")).otherwise(F.lit("pending")))
    out = (j.withColumn("genres", genres)
           .withColumn("enrichment_source", source)
           .withColumn("pending_enrichment", source == "pending")
           .withColumn("artist_popularity", F.when(answered, F.col("_apop")))
           .withColumn("track_popularity", F.when(answered, F.col("_tpop")))
           .withColumn("genres", F.when(F.coalesce(F.size("genres"), F.lit(0)) > 0, F.col("genres"))
                       .when(F.size(atags) > 0, atags).otherwise(F.col("genres"))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])
