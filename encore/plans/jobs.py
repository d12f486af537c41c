"""Batch jobs over the artist table.

Each job is a function from state DataFrames (+ landed payloads and an
explicit ``as_of``) to the new state and the rows it emits; none mutates
anything in place, so a rerun over the same inputs gives the same output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.operators.dedup import similar_dedup
from encore.operators.enrich import backfill_artist_tags
from encore.operators.joins import follow_semi
from encore.operators.ordered import best_score_with_evidence
from encore.functions.scoring import ScoreWeights
from encore.plans.stages import NOVEL_EVENT_COLUMNS, score_events
from encore.sources.bindings import STATUSES
from encore.sources.payloads import missing_pages, raw_plays, read_play_pages
from encore.streaming.state import advance_checkpoint


def _ts(as_of):
    return F.to_timestamp_ntz(F.lit(as_of)) if isinstance(as_of, str) else as_of


def eligible(artists: DataFrame, ts_col: str, older_than) -> DataFrame:
    """FOLLOWING and never explored or explored before the cutoff."""
    c = F.col(ts_col)
    return artists.filter((F.col("status") == "FOLLOWING") & (c.isNull() | (c < older_than)))


# ---------------------------------------------------------------- T7 similar expansion
def mark_explored(artists: DataFrame, explored: DataFrame, ts_col: str, now) -> DataFrame:
    """``ts_col`` := now for the artists whose id is in ``explored``."""
    x = explored.select(F.col("id").alias("_xid")).distinct().withColumn("_x", F.lit(True))
    return (artists.join(x, F.col("id") == F.col("_xid"), "left")
            .withColumn(ts_col, F.when(F.col("_x"), now).otherwise(F.col(ts_col))).drop("_xid", "_x"))


def similar_origins(artists: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """The artists whose similar artists are due."""
    return eligible(artists, "last_similar_explored_at", _ts(as_of) - F.make_interval(hours=F.lit(hours)))


def mark_similar_explored(artists: DataFrame, answered: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """U6 after T7: due artists that got an answer (an empty list included)."""
    due = similar_origins(artists, as_of, hours).join(answered.select(F.col("artist").alias("name")).distinct(),
                                                      "name", "left_semi")
    return mark_explored(artists, due, "last_similar_explored_at", _ts(as_of))


def similar_candidates_judged(artists: DataFrame, similar: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """D3 over the answers of the due artists: every candidate with its outcome."""
    o = similar_origins(artists, as_of, hours).select(
        F.col("id").alias("origin_artist_id"), F.col("name").alias("origin_artist_name"),
        "last_similar_explored_at", "name_key")
    cand = (similar.join(o, similar.artist == o.origin_artist_name)
            .withColumn("ord", F.struct(F.col("last_similar_explored_at").isNotNull().alias("_e"),
                                        F.col("last_similar_explored_at").alias("_t"),
                                        F.col("name_key").alias("_k"), F.col("position").alias("_p")))
            .select("ord", "origin_artist_id", "origin_artist_name", "position", "name", "mbid", "match"))
    return similar_dedup(cand, artists)


def expand_similar(artists: DataFrame, similar: DataFrame, as_of, hours: int = 24,
                   answered: DataFrame | None = None, outcomes: DataFrame | None = None):
    """P15 -> S11 -> D3 -> insert TRACKED / LASTFM_SIMILAR -> P19 events
    -> mark explored. ``similar`` = read_similar_payload output (artist,
    position, name, mbid, match). Origins are processed oldest-explored first
    (never explored on top), then by name; candidates in list order.
    ``answered`` names the artists whose answer arrived (``similar`` alone
    does not show empty answers); ``outcomes`` are those already judged for
    the same state. Returns (outcomes, new_artist_rows, discovery_events,
    artists_after)."""
    now = _ts(as_of)
    if outcomes is None:
        outcomes = similar_candidates_judged(artists, similar, as_of, hours)
    inserted = outcomes.filter(F.col("outcome") == "inserted")
    new_rows = inserted.select(
        F.sha2(F.col("name_key"), 256).alias("id"), "name", "name_key", F.lit("TRACKED").alias("status"),
        F.lit(False).alias("high_priority"), "origin_artist_id", F.lit("LASTFM_SIMILAR").alias("source"),
        F.lit(None).cast("timestamp_ntz").alias("last_explored_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_similar_explored_at"),
        F.lit(None).cast("string").alias("spotify_uri"), F.col("mbid").alias("lastfm_mbid"),
        F.lit(0).cast("bigint").alias("play_count"), F.lit(0).cast("bigint").alias("scrobble_count"),
        F.lit(None).cast("array<string>").alias("genres"), now.alias("added_at"))
    events = inserted.select(F.to_json(F.struct(
        F.col("name").alias("artist_name"), F.lit("LASTFM_SIMILAR").alias("source"),
        "origin_artist_id", "origin_artist_name", F.col("mbid").alias("lastfm_mbid"))).alias("value"),
        F.col("name").alias("key"))
    marked = mark_similar_explored(artists, similar if answered is None else answered, as_of, hours)
    after = marked.unionByName(new_rows.select(*marked.columns))
    return outcomes, new_rows, events, after


# ---------------------------------------------------------------- T6 top-track exploration
def explore_top_tracks(artists: DataFrame, top_tracks: DataFrame, as_of, days: int = 7,
                       answered: DataFrame | None = None, folded: bool = False):
    """P14 -> S12 -> P18 raw-track messages -> mark explored. Artists
    without a spotify id are skipped; marked are those whose answer arrived
    (``answered``, an empty list included). Artist rows of one id send the same
    messages: ``folded`` has them once, with their number as ``copies``."""
    now = _ts(as_of)
    due = eligible(artists, "last_explored_at", now - F.make_interval(days=F.lit(days))) \
        .filter(F.col("spotify_uri").isNotNull())
    senders = due.groupBy("id", "name").agg(F.count(F.lit(1)).alias("copies")) if folded else due
    msgs = senders.join(top_tracks, senders.name == top_tracks.artist).select(
        F.lit("spotify").alias("source"), F.col("track_artist").alias("artist"),
        F.concat(F.lit("spotify:artist:"), F.col("track_artist_ref")).alias("artist_id"),
        F.concat(F.lit("spotify:track:"), F.col("track_ref")).alias("track_id"),
        "title", "rank",
        F.struct(F.lit("top_tracks").alias("type"), F.col("id").alias("origin_artist_id")).alias("origin"),
        *(["copies"] if folded else []))
    came = (top_tracks if answered is None else answered).select(F.col("artist").alias("name")).distinct()
    return msgs, mark_explored(artists, due.join(came, "name", "left_semi"), "last_explored_at", now)


# ---------------------------------------------------------------- U5 status decisions
def apply_status_decisions(artists: DataFrame, decisions: DataFrame):
    """decisions(artist_id, status, decided_at, tie); the last valid
    decision per artist wins. Returns (artists_after, unknown_ids)."""
    valid = decisions.filter(F.col("status").isin(*STATUSES))
    last = valid.groupBy("artist_id").agg(
        F.max_by("status", F.struct("decided_at", "tie")).alias("_new"),
        F.max(F.struct("decided_at", "tie"))["decided_at"].alias("_at"))
    after = (artists.join(last, F.col("id") == F.col("artist_id"), "left")
             .withColumn("previous_status", F.col("status"))
             .withColumn("status", F.coalesce("_new", "status"))
             .withColumnRenamed("_at", "decided_at").drop("artist_id", "_new"))
    unknown = last.join(artists.select(F.col("id").alias("artist_id")), "artist_id", "left_anti")
    return after, unknown


# ---------------------------------------------------------------- onboarding U8/U9
def onboard(artists: DataFrame, followed_names: DataFrame, min_scrobbles: int = 20) -> DataFrame:
    """U8 then U9: followed names become FOLLOWING (any other status,
    blacklisted included); then TRACKED artists with at least
    ``min_scrobbles`` scrobbles become high priority."""
    hit = follow_semi(artists, followed_names).select(F.col("id").alias("_fid"), F.lit(True).alias("_f"))
    a = (artists.join(hit, F.col("id") == F.col("_fid"), "left")
         .withColumn("status", F.when(F.col("_f").isNotNull() & (F.col("status") != "FOLLOWING"),
                                      F.lit("FOLLOWING")).otherwise(F.col("status")))
         .drop("_fid", "_f"))
    promote = (F.col("status") == "TRACKED") & (F.col("scrobble_count") >= min_scrobbles) & ~F.col("high_priority")
    return a.withColumn("high_priority", F.when(promote, F.lit(True)).otherwise(F.col("high_priority")))


# ---------------------------------------------------------------- backfills U10/U11
def missing_genres(artists: DataFrame) -> DataFrame:
    """No genres yet. ``backfill_order`` is the order of work."""
    return artists.filter(F.col("genres").isNull() | (F.size("genres") == 0))


def backfill_order() -> list:
    """Followed artists first, tracked ones next, all others equal; then most played."""
    rank = F.when(F.col("status") == "FOLLOWING", 0).when(F.col("status") == "TRACKED", 1).otherwise(2)
    return [rank, F.col("play_count").desc_nulls_last(), F.col("name_key")]


def backfill_genres(artists: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Genres := backfill tags (count >= 15, then first five) where
    missing and the answer is non-empty; ``outcome`` updated / skipped."""
    todo = missing_genres(artists).select("id", "name", "status", "play_count", "name_key")
    tags = artist_tags.select(F.col("artist").alias("_ta"), backfill_artist_tags("tags").alias("_bt"))
    j = todo.join(tags, F.col("name") == F.col("_ta"), "left")
    return j.orderBy(*backfill_order()).select("id", "name", F.when(F.size("_bt") > 0, F.col("_bt")).alias("genres"),
                    F.when(F.coalesce(F.size("_bt"), F.lit(0)) > 0, F.lit("updated")).otherwise(F.lit("skipped"))
                    .alias("outcome"))


def missing_entity_id(artists: DataFrame) -> DataFrame:
    """No spotify id in the external ids. Worked off in ``backfill_order``."""
    return artists.filter(F.col("spotify_uri").isNull())


def backfill_entity_ids(artists: DataFrame, resolved: DataFrame) -> DataFrame:
    """Merge {spotify: uri} into P17 rows where the search resolved one.
    ``resolved(name, uri)``."""
    r = resolved.groupBy(F.col("name").alias("_rn")).agg(F.min("uri").alias("_uri"))
    todo = missing_entity_id(artists)
    return todo.join(r, F.col("name") == F.col("_rn"), "left").orderBy(*backfill_order()).select(
        "id", "name", F.col("_uri").alias("spotify_uri"),
        F.when(F.col("_uri").isNotNull(), F.lit("updated")).otherwise(F.lit("unresolved")).alias("outcome"))


def backfilled(artists: DataFrame, genres: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The artists that the reports of U10 and U11 change, as they are
    afterwards: what a keyed state table has to rewrite."""
    out = artists
    for report, column in ((genres, "genres"), (ids, "spotify_uri")):
        new = f"_new_{column}"
        if report is None:
            out = out.withColumn(new, F.lit(None).cast(artists.schema[column].dataType))
            continue
        hit = report.where("outcome = 'updated'").select(F.col("id").alias("_rid"), F.col(column).alias(new))
        out = out.join(hit, F.col("id") == F.col("_rid"), "left").drop("_rid")
    changed = F.col("_new_genres").isNotNull() | F.col("_new_spotify_uri").isNotNull()
    return out.where(changed).withColumns({
        c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in ("genres", "spotify_uri")}).drop("_new_genres", "_new_spotify_uri")


def after_backfills(artists: DataFrame, genres: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The whole artist table after the backfills."""
    changed = backfilled(artists, genres, ids)
    return artists.join(changed.select("id"), "id", "left_anti").select(artists.columns).unionByName(
        changed.select(artists.columns))


class IncompletePull(ValueError):
    """Pages of a full pull are missing."""


def full_backfill(pages: DataFrame, marks: DataFrame | None, service: str,
                  land=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """All plays of all pages, and the marks with the service's newest
    play. Raises IncompletePull if a page is missing, so that no mark is set
    beyond plays that were never seen. ``land`` writes the plays, so that
    their pages are parsed once."""
    gap = missing_pages(pages).first()
    if gap is not None:
        raise IncompletePull(f"page {gap['page']} of {gap['user']} is missing")
    plays = land(raw_plays(read_play_pages(pages)), "plays")
    return plays, advance_checkpoint(marks, plays, service)


def replay_scores(novel_events: DataFrame, artists: DataFrame, weights: ScoreWeights) -> DataFrame:
    """The whole log of novel events through the scorer with other
    weights, into a fresh recommendation table."""
    scored = score_events(novel_events.select(*NOVEL_EVENT_COLUMNS), artists, weights)
    return best_score_with_evidence(scored.filter(F.col("route") == "ok"))


def artist_schema_upgrade(v1: DataFrame) -> DataFrame:
    """An artist table from before play counting and similar expansion
    gets the columns of both."""
    added = (("scrobble_count", F.lit(0).cast("bigint")), ("origin_artist_id", F.lit(None).cast("string")),
             ("source", F.lit(None).cast("string")),
             ("last_similar_explored_at", F.lit(None).cast("timestamp_ntz")),
             ("lastfm_mbid", F.lit(None).cast("string")))
    for name, default in added:
        if name not in v1.columns:
            v1 = v1.withColumn(name, default)
    return v1


def schema_upgrade(v1: DataFrame) -> DataFrame:
    """v1 history snapshot -> v2 columns (audio features dropped,
    popularity renamed, track popularity added)."""
    df = v1.drop("audio_features") if "audio_features" in v1.columns else v1
    if "popularity" in df.columns and "artist_popularity" not in df.columns:
        df = df.withColumnRenamed("popularity", "artist_popularity")
    if "track_popularity" not in df.columns:
        df = df.withColumn("track_popularity", F.lit(None).cast("int"))
    return df
