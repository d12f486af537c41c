"""Join operators.

Equi-joins only; Catalyst/AQE pick broadcast vs. shuffle from measured sizes
(spark.sql.adaptive.autoBroadcastJoinThreshold), and AQE splits skewed
partitions. Lookup sides are de-duplicated on their key first so a join can
never multiply rows.

A lookup that the whole log meets is counted first (``light``): AQE turns a
join into a broadcast only after both sides have been shuffled, so that the
log lies on disk once more for a table of a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.functions.text import EVIDENCE_SEPARATOR

# counted bytes of a lookup that every executor may hold at once
LOOKUP_BYTES = 64 << 20
# what a row takes besides its values
ROW_BYTES = 32


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value as it stands in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
    if isinstance(kind, T.ArrayType):
        items = F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + _bytes(x, kind.elementType))
        return F.coalesce(items, F.lit(0)) + 16
    return F.lit(8).cast("bigint")


def fits(df: DataFrame, limit: int = LOOKUP_BYTES) -> bool:
    """Whether the rows of ``df``, counted, take no more than ``limit`` bytes (one job)."""
    row = sum((_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("bigint"))
    return (df.select(row.alias("n")).agg(F.sum("n")).first()[0] or 0) <= limit


def light(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it fits, else as it is."""
    return F.broadcast(df) if fits(df) else df


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def artist_lookup(events: DataFrame, artists: DataFrame, uri_col: str = "artist_id",
                  name_col: str = "artist") -> DataFrame:
    """Resolve each event's artist, first by external id, else by the
    case-folded name. Adds ``rec_artist_id`` and ``rec_high_priority`` (null
    when unresolvable). Ambiguous keys resolve to the smallest name key."""
    by_uri = (artists.filter(F.col("spotify_uri").isNotNull())
              .groupBy(F.col("spotify_uri").alias("_uri"))
              .agg(F.min_by(F.struct("id", "high_priority"), F.col("name_key")).alias("_u")))
    by_name = (artists.groupBy(F.col("name_key").alias("_nk"))
               .agg(F.min_by(F.struct("id", "high_priority"), F.col("id")).alias("_n")))
    j = (events.join(by_uri, F.col(uri_col) == F.col("_uri"), "left")
         .join(by_name, F.lower(F.col(name_col)) == F.col("_nk"), "left"))
    hit = F.coalesce(F.col("_u"), F.col("_n"))
    return (j.withColumn("rec_artist_id", hit["id"])
            .withColumn("rec_high_priority", hit["high_priority"])
            .drop("_uri", "_u", "_nk", "_n"))


def evidence_labels(recs: DataFrame, history: DataFrame) -> DataFrame:
    """Map each evidence track key to ``artist — title`` when the track
    is in history, else keep the key; array order kept; empty -> []."""
    ex = recs.select("artist_id", F.posexplode("evidence_tracks").alias("pos", "track_key"))
    found = history.select("track_key", "artist", "title").join(
        ex.select("track_key").distinct(), "track_key", "left_semi")
    labelled = (ex.join(found, "track_key", "left")
                .select("artist_id", "pos",
                        F.when(F.col("title").isNotNull(),
                               F.concat(F.col("artist"), F.lit(EVIDENCE_SEPARATOR), F.col("title")))
                        .otherwise(F.col("track_key")).alias("label")))
    agg = (labelled.groupBy("artist_id")
           .agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("_l"))
           .select("artist_id", F.transform("_l", lambda x: x["label"]).alias("evidence_labels")))
    return (recs.join(agg, "artist_id", "left")
            .withColumn("evidence_labels", F.coalesce("evidence_labels", F.array().cast("array<string>"))))


def artist_origin(rows: DataFrame, artists: DataFrame | None = None) -> DataFrame:
    """Rows LEFT JOIN artists AS origin on origin_artist_id (the origin
    side is always the whole artist table, not the filtered rows)."""
    src = rows if artists is None else artists
    o = src.select(F.col("id").alias("_oid"), F.col("name").alias("origin_artist_name"))
    return rows.join(o, F.col("origin_artist_id") == F.col("_oid"), "left").drop("_oid")


def artist_detail(artists: DataFrame, recs: DataFrame) -> DataFrame:
    """Artist plus its recommendation (null object when unscored)."""
    r = recs.select(F.col("artist_id").alias("_rid"), "score", "score_breakdown",
                    "evidence_tracks", F.col("updated_at").alias("rec_updated_at"))
    j = artists.join(r, F.col("id") == F.col("_rid"), "left").drop("_rid")
    rec = F.when(F.col("score").isNotNull(), F.struct(
        F.col("score"),
        F.struct(F.coalesce(F.col("score_breakdown.genre_novelty"), F.lit(0.0)).alias("genre_novelty"),
                 F.coalesce(F.col("score_breakdown.popularity_norm"), F.lit(0.0)).alias("popularity_norm"))
        .alias("score_breakdown"),
        F.coalesce(F.col("evidence_tracks"), F.array().cast("array<string>")).alias("evidence_tracks"),
        F.col("rec_updated_at").alias("updated_at")))
    return j.withColumn("recommendation", rec).drop("score_breakdown", "evidence_tracks", "rec_updated_at")


def rec_artist(recs: DataFrame, artists: DataFrame) -> DataFrame:
    """Recommendations JOIN artists."""
    a = artists.select(F.col("id").alias("artist_id"), "name", "name_key", "status", "high_priority",
                       "genres", "spotify_uri")
    return recs.join(a, "artist_id")


def plays_with_artist(history: DataFrame, artists: DataFrame) -> DataFrame:
    """History LEFT JOIN artists on the exact (case-sensitive) name."""
    a = artists.select(F.col("name").alias("_an"), F.col("added_at").alias("artist_added_at"))
    return history.join(a, F.col("artist") == F.col("_an"), "left").drop("_an")


def follow_semi(artists: DataFrame, follows: DataFrame) -> DataFrame:
    """Artists whose case-folded name is in the followed set."""
    f = follows.select(F.lower(F.col("name")).alias("name_key")).distinct()
    return artists.join(f, "name_key", "left_semi")
