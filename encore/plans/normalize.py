"""T2 normalize stage: P1 -> F2 -> J1 -> P2, and P3/P4 message routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.text import is_valid_text, track_key


def valid_raw(raw: DataFrame) -> DataFrame:
    """Artist and title non-blank after strip and <= 500 code points;
    invalid rows are dropped (no DLQ)."""
    return raw.filter(is_valid_text(F.col("artist")) & is_valid_text(F.col("title")))


def first_hits(catalog: DataFrame) -> DataFrame:
    """The first search hit per (artist, title): a lookup table of one row per query."""
    return (catalog.groupBy("q_artist", "q_title")
            .agg(F.min_by(F.struct("artist_uri", "track_uri"), F.struct("rank", "track_uri")).alias("_hit"))
            .select("q_artist", "q_title", "_hit.artist_uri", "_hit.track_uri"))


def resolve_ids(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The first hit per (artist, title) gives both URIs (both or
    neither); a miss keeps the row with null ids. Ids already on the input are
    ignored and re-resolved."""
    rows = rows.drop(*[c for c in ("artist_id", "track_id") if c in rows.columns])
    j = rows.join(hits, (F.col("artist") == F.col("q_artist")) & (F.col("title") == F.col("q_title")), "left")
    return (j.withColumnsRenamed({"artist_uri": "artist_id", "track_uri": "track_id"})
            .drop("q_artist", "q_title"))


def normalize_stage(raw: DataFrame, catalog: DataFrame | None = None, hits: DataFrame | None = None,
                    processed_at: Column | None = None) -> DataFrame:
    """Raw plays/tracks -> normalized messages keyed by track key. ``hits``
    is ``first_hits(catalog)`` where that is landed already; ``processed_at``
    stamps the messages. A ``seq`` and the ``copies`` of folded messages on the
    input are carried along. Works on a stream too: the lookup is a
    stream-static left join."""
    keyed = valid_raw(raw).withColumn("track_key", track_key(F.col("artist"), F.col("title")))
    source = F.coalesce(F.col("source"), F.lit("lastfm"))
    out = ["track_key", "artist", "title", "artist_id", "track_id", F.array(source).alias("sources"),
           (source == "lastfm").alias("played"), "played_at"]
    out += [c for c in ("seq", "copies") if c in raw.columns]
    if processed_at is not None:
        out.append(processed_at.alias("processed_at"))
    return resolve_ids(keyed, first_hits(catalog) if hits is None else hits).select(*out)


def unfold(messages: DataFrame) -> DataFrame:
    """Folded messages as often as their ``copies`` say (null: once)."""
    times = F.array_repeat(F.lit(True), F.coalesce("copies", F.lit(1)).cast("int"))
    return messages.withColumn("copies", F.explode(times)).drop("copies")


def valid_normalized(df: DataFrame) -> DataFrame:
    """Track key, artist and title present (may be empty)."""
    return df.filter(F.col("track_key").isNotNull() & F.col("artist").isNotNull() & F.col("title").isNotNull())


def route_history(df: DataFrame) -> DataFrame:
    """Null track key -> DLQ NULL_TRACK_KEY; missing artist/title ->
    dropped; played false -> skipped (absent counts as true); else apply."""
    return df.withColumn(
        "route",
        F.when(F.col("track_key").isNull(), F.lit("NULL_TRACK_KEY"))
        .when(F.col("artist").isNull() | F.col("title").isNull(), F.lit("dropped"))
        .when(~F.coalesce(F.col("played"), F.lit(True)), F.lit("skipped_not_played"))
        .otherwise(F.lit("apply")))
