"""Order-dependent operators (W1-W7) written as set operations over ``seq``.

The reference computes these one message at a time against a database. Here
each one is a shuffle-friendly formulation whose result equals the sequential
one when messages are applied in ``seq`` order:

* W2 first-seen history: ``min_by`` per track key (partial aggregation, so a
  hot key never lands whole in one task).
* W1 novelty: for each artist key and each genre keep only the **first two**
  history rows (``row_number() <= 2`` becomes a WindowGroupLimit that prunes
  before the shuffle); "is there an earlier history row of another track" is
  then answered from those two rows by an equi-join.
* W6 best score: a row is a record iff its score is strictly greater than every
  earlier score. Records are found per *distinct score value*: the first
  occurrence of each value, kept iff no higher value occurred earlier. The
  work per artist is bounded by its number of distinct scores, not its rows.
* W7 auto-promotion: the N-th played message per artist (top-N window with
  group limit) and the first valid message at or after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.scoring import clean_genres, genre_novelty_ratio, known_genres
from encore.operators.joins import as_it_is

HISTORY_COLUMNS = ["track_key", "artist", "artist_key", "title", "artist_id", "track_id",
                   "genres", "artist_popularity", "track_popularity", "played_at",
                   "enrichment_source", "pending_enrichment", "sources", "seq"]


def applied_to_history(messages: DataFrame) -> DataFrame:
    """Messages the history stage applies: track key, artist and title present
    and ``played`` not false (absent counts as true)."""
    return messages.filter(F.col("track_key").isNotNull() & F.col("artist").isNotNull() &
                           F.col("title").isNotNull() & F.coalesce(F.col("played"), F.lit(True)))


def first_seen_history(messages: DataFrame, state: DataFrame | None = None, land=lambda name, df: df,
                       fits: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """One row per track key, the first delivery wins (insert-if-absent).

    With ``fits`` the first ``seq`` of every track is landed; if it fits, only
    those deliveries are shuffled whole, else the first of every map task are."""
    sources = F.col("sources") if "sources" in messages.columns else F.array("source")
    applied = applied_to_history(messages)
    if fits is not None:
        firsts = land("first_seqs", applied.groupBy("track_key").agg(F.min("seq").alias("seq")))
        if fits(firsts):
            applied = applied.join(F.broadcast(firsts), ["track_key", "seq"], "left_semi")
    rows = applied.select(
        *[c for c in HISTORY_COLUMNS if c not in ("genres", "pending_enrichment", "sources")],
        F.coalesce(sources, F.array().cast("array<string>")).alias("sources"),
        F.coalesce(F.col("genres"), F.array().cast("array<string>")).alias("genres"),
        F.coalesce(F.col("pending_enrichment"), F.lit(False)).alias("pending_enrichment"),
    ).select(*HISTORY_COLUMNS)
    if state is not None:
        rows = state.select(*HISTORY_COLUMNS).unionByName(rows)
    payload = [c for c in HISTORY_COLUMNS if c != "track_key"]
    return (rows.groupBy("track_key")
            .agg(F.min_by(F.struct(*payload), F.col("seq")).alias("r"))
            .select("track_key", "r.*"))


def artist_counters(messages: DataFrame, inserted: DataFrame) -> DataFrame:
    """W3-W5 per artist key over one batch of applied messages.

    scrobble_count: every applied message; play_count: messages that inserted
    a history row (``inserted``: the history rows this batch added); genres:
    latest non-empty list; spotify_uri: latest artist id (right side wins);
    name: first spelling; first_played_at: first play.
    """
    applied = applied_to_history(messages)
    new_tracks = inserted.groupBy("artist_key").agg(F.count(F.lit(1)).alias("play_delta"))
    agg = applied.groupBy("artist_key").agg(
        F.min_by("artist", "seq").alias("first_name"),
        F.count(F.lit(1)).alias("scrobble_delta"),
        F.max_by(F.when(F.size("genres") > 0, F.col("genres")),
                 F.when(F.size("genres") > 0, F.col("seq"))).alias("latest_genres"),
        F.max_by(F.col("artist_id"), F.when(F.col("artist_id").isNotNull() & (F.col("artist_id") != ""),
                                            F.col("seq"))).alias("latest_artist_id"),
        F.min("played_at").alias("first_played_at"),
        F.max("played_at").alias("last_played_at"),
    )
    return agg.join(new_tracks, "artist_key", "left").fillna(0, ["play_delta"])


ARTIST_COLUMNS = ["id", "name", "name_key", "status", "high_priority", "origin_artist_id", "source",
                  "last_explored_at", "last_similar_explored_at", "spotify_uri", "lastfm_mbid",
                  "play_count", "scrobble_count", "genres", "added_at"]


def upsert_artists(state: DataFrame, counters: DataFrame) -> DataFrame:
    """Merge per-batch artist counters into the artist table (full outer
    join on the case-folded name; unseen names enter as TRACKED)."""
    s = state
    for c, default in (("play_count", F.lit(0).cast("bigint")), ("scrobble_count", F.lit(0).cast("bigint")),
                       ("genres", F.lit(None).cast("array<string>")),
                       ("added_at", F.lit(None).cast("timestamp_ntz"))):
        if c not in s.columns:
            s = s.withColumn(c, default)
    c = counters.withColumnRenamed("artist_key", "name_key")
    j = s.select(*ARTIST_COLUMNS).join(c, "name_key", "full_outer")
    is_new = F.col("id").isNull()
    return j.select(
        F.when(is_new, F.sha2(F.col("name_key"), 256)).otherwise(F.col("id")).alias("id"),
        F.coalesce(F.col("name"), F.col("first_name")).alias("name"),
        F.col("name_key"),
        F.coalesce(F.col("status"), F.lit("TRACKED")).alias("status"),
        F.coalesce(F.col("high_priority"), F.lit(False)).alias("high_priority"),
        "origin_artist_id", "source", "last_explored_at", "last_similar_explored_at",
        F.coalesce(F.col("latest_artist_id"), F.col("spotify_uri")).alias("spotify_uri"),
        "lastfm_mbid",
        (F.coalesce(F.col("play_count"), F.lit(0)) + F.coalesce(F.col("play_delta"), F.lit(0)))
        .cast("bigint").alias("play_count"),
        (F.coalesce(F.col("scrobble_count"), F.lit(0)) + F.coalesce(F.col("scrobble_delta"), F.lit(0)))
        .cast("bigint").alias("scrobble_count"),
        F.coalesce(F.col("latest_genres"), F.col("genres")).alias("genres"),
        F.coalesce(F.col("added_at"), F.col("first_played_at")).alias("added_at"),
    )


def first_two_rows(rows: DataFrame, key: str) -> DataFrame:
    """Per key the two earliest (seq, track_key) rows, long form. Mergeable:
    first_two_rows(previous result ∪ new rows) is the result over all rows,
    so it is kept as streaming state (size: 2 rows per key)."""
    w = Window.partitionBy(key).orderBy("seq")
    return (rows.select(key, "seq", "track_key").withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= 2).drop("_rn"))


def pivot_first_two(top: DataFrame, key: str) -> DataFrame:
    """Long first-two rows -> one row per key with s1,t1,s2,t2."""
    return (top.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("seq", "track_key"))).alias("_f2"))
            .select(key,
                    # get(): NULL when a key has a single row (no ANSI index error)
                    F.get("_f2", 0)["seq"].alias("s1"), F.get("_f2", 0)["track_key"].alias("t1"),
                    F.get("_f2", 1)["seq"].alias("s2"), F.get("_f2", 1)["track_key"].alias("t2")))


def first_two(rows: DataFrame, key: str) -> DataFrame:
    """Per key the two earliest (seq, track_key) rows as columns s1,t1,s2,t2."""
    return pivot_first_two(first_two_rows(rows, key), key)


def artist_rows(history: DataFrame) -> DataFrame:
    return history.select("artist_key", "seq", "track_key")


def genre_rows(history: DataFrame) -> DataFrame:
    """One row per distinct genre of a history row (containment counts once)."""
    return (history.select(F.explode(F.array_distinct("genres")).alias("genre"), "seq", "track_key")
            .filter(F.col("genre").isNotNull()))


def _first_other(own_track) -> F.Column:
    """seq of the first history row of another track (null: none), from the
    key's first two history rows (s1,t1) and (s2,t2)."""
    return F.when(F.col("t1") != own_track, F.col("s1")).otherwise(F.col("s2"))


def _still_new(first_other, own_seq) -> F.Column:
    """True iff no history row of another track precedes the message."""
    return ~F.coalesce(first_other < own_seq, F.lit(False))


def novelty_signals(messages: DataFrame, history: DataFrame | None = None, *,
                    f2_artist: DataFrame | None = None, f2_genre: DataFrame | None = None,
                    track_first: DataFrame | None = None, land=lambda name, df: df,
                    few: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """W1 (J3+J4+J5+F8+P8): novelty of each message against the history rows
    strictly before it.

    artist_is_new: no earlier history row with the same case-folded artist and
    another track key. A genre is new when no earlier history row of another
    track contains it. track_is_new: the track's first history row is not
    earlier than the message. Duplicates and order of the genre list are kept.

    ``land`` writes the genres that are new to some message of a track: rows
    grow with the tracks that bring a genre, not with their plays. ``few`` marks
    lookups that fit for a broadcast; beyond, the joins shuffle.
    """
    if history is not None:
        hist = history.select("track_key", "artist_key", "genres", "seq")
        f2_artist = first_two(artist_rows(hist), "artist_key")
        f2_genre = first_two(genre_rows(hist), "genre")
        track_first = hist.select("track_key", "seq")
    track_first = few(track_first.select("track_key", F.col("seq").alias("track_seq")))

    # flags are computed on the message rows themselves (the per-key tables are
    # equi-joined); a genre is new up to the first row of another track (``until``)
    m = messages.withColumn("genres", clean_genres("genres"))
    opened = few(land("genre_hits", (
        m.select("track_key", "genres", "seq", F.posexplode("genres").alias("pos", "genre"))
        .join(few(f2_genre), "genre", "left")
        .withColumn("until", _first_other(F.col("track_key")))
        .filter(_still_new(F.col("until"), F.col("seq")))
        .groupBy("track_key", "genres")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "genre", "until"))).alias("_open")))))
    found = F.filter("_open", lambda x: _still_new(x["until"], F.col("seq")))
    m = (m.join(few(f2_artist), "artist_key", "left")
         .withColumn("artist_is_new", _still_new(_first_other(F.col("track_key")), F.col("seq")))
         .drop("s1", "t1", "s2", "t2")
         .join(opened, ["track_key", "genres"], "left")
         .withColumn("_ng", F.coalesce(found, F.array().cast(opened.schema["_open"].dataType)))
         .drop("_open"))

    # messages of one seq list their new genres together; the copies of a folded row are such messages
    copies = F.coalesce("copies", F.lit(1)).cast("int") if "copies" in messages.columns else F.lit(1)
    hits = F.transform("_ng", lambda x: F.struct(x["pos"].alias("pos"), x["genre"].alias("genre"), copies.alias("n")))
    listed = F.sort_array(F.flatten(F.collect_list(hits).over(Window.partitionBy("seq"))))
    with_new = m.filter(F.size("_ng") > 0).withColumn("new_genres", F.flatten(
        F.transform(listed, lambda x: F.array_repeat(x["genre"], x["n"]))))
    without = m.filter(F.size("_ng") == 0).withColumn("new_genres", F.array().cast("array<string>"))
    return (with_new.unionByName(without).drop("_ng")
            .join(track_first, "track_key", "left")
            .withColumn("track_is_new", F.col("track_seq").isNull() | (F.col("track_seq") >= F.col("seq")))
            .drop("track_seq")
            .withColumn("known_genres", known_genres("genres", "new_genres"))
            .withColumn("genre_novelty_ratio", genre_novelty_ratio("new_genres", "genres")))


def best_score_with_evidence(scored: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per recommended artist keep the maximum score, the breakdown of
    its first occurrence, and the track keys of every strict improvement in
    arrival order (no repeats).

    ``scored`` has rec_artist_id, score, breakdown, track_key, seq, played_at.
    ``state`` (optional) has artist_id, score, score_breakdown,
    evidence_tracks, updated_at and acts as the earliest row.
    """
    rows = scored.select(
        F.col("rec_artist_id").alias("artist_id"), "score", F.col("breakdown"), "track_key",
        F.struct(F.lit(1).alias("rank"), F.col("seq").alias("seq")).alias("ord"), "played_at")
    if state is not None:
        seq_type = scored.schema["seq"].dataType.simpleString()
        rows = rows.unionByName(state.select(
            "artist_id", "score", F.col("score_breakdown").alias("breakdown"),
            F.lit(None).cast("string").alias("track_key"),
            F.struct(F.lit(0).alias("rank"), F.lit(None).cast(seq_type).alias("seq")).alias("ord"),
            F.col("updated_at").alias("played_at")))
    # first occurrence of every distinct score value (partial aggregation)
    firsts = rows.groupBy("artist_id", "score").agg(
        F.min_by(F.struct("ord", "track_key", "breakdown"), F.col("ord")).alias("f"),
        F.max("played_at").alias("last_at"))
    w = Window.partitionBy("artist_id").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    flagged = firsts.withColumn("higher_first", F.min(F.col("f.ord")).over(w))
    records = flagged.filter(F.col("higher_first").isNull() | (F.col("f.ord") < F.col("higher_first")))
    best = records.groupBy("artist_id").agg(
        F.max("score").alias("score"),
        F.max_by(F.col("f.breakdown"), F.col("score")).alias("score_breakdown"),
        F.sort_array(F.collect_list(F.struct(F.col("f.ord").alias("ord"),
                                             F.col("f.track_key").alias("k")))).alias("_ev"))
    last = firsts.groupBy("artist_id").agg(F.max("last_at").alias("updated_at"))
    out = best.join(last, "artist_id").withColumn(
        "evidence_tracks",
        F.array_distinct(F.filter(F.transform("_ev", lambda x: x["k"]), lambda k: k.isNotNull())))
    if state is not None:
        out = (out.join(state.select("artist_id", F.col("evidence_tracks").alias("_old_ev")), "artist_id", "left")
               .withColumn("evidence_tracks", F.array_distinct(
                   F.concat(F.coalesce("_old_ev", F.array().cast("array<string>")), "evidence_tracks")))
               .drop("_old_ev"))
    return out.select("artist_id", "score", "score_breakdown", "evidence_tracks", "updated_at")


def counts_before(state: DataFrame, counters: DataFrame) -> DataFrame:
    """name_key, status and scrobble_count before the batch; names that the
    batch brings enter as TRACKED without plays."""
    count = F.col("scrobble_count") if "scrobble_count" in state.columns else F.lit(0)
    known = state.select("name_key", "status", F.coalesce(count, F.lit(0)).cast("bigint").alias("scrobble_count"))
    return known.join(counters.select(F.col("artist_key").alias("name_key")), "name_key", "full_outer").select(
        "name_key", F.coalesce("status", F.lit("TRACKED")).alias("status"),
        F.coalesce("scrobble_count", F.lit(0)).cast("bigint").alias("scrobble_count"))


def apply_promotions(artists: DataFrame, promotions: DataFrame) -> DataFrame:
    """U4: TRACKED -> FOLLOWING for the artists W7 promoted."""
    p = promotions.select(F.col("name_key").alias("_pk"), "promoted_at")
    return (artists.join(p, F.col("name_key") == F.col("_pk"), "left")
            .withColumn("status", F.when(F.col("promoted_at").isNotNull() & (F.col("status") == "TRACKED"),
                                         F.lit("FOLLOWING")).otherwise(F.col("status")))
            .drop("_pk"))


def auto_promotions(messages: DataFrame, artists: DataFrame, min_scrobbles: int = 3,
                    land=lambda name, df: df, few: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """TRACKED artists whose scrobble count reaches ``min_scrobbles``
    by the time any valid, non-pending message of theirs is processed.

    The count seen by a message includes its own play (the history stage runs
    first). Returns name_key, promoted_at (the promoting message's played_at).
    Of artist rows that share a name the one with most scrobbles counts.

    ``land`` writes the (name, reaching play) rows, ``few`` marks them for a
    broadcast if they fit; else the messages meet them in a shuffle.
    """
    tracked = (artists.filter(F.col("status") == "TRACKED").groupBy("name_key")
               .agg(F.max("scrobble_count").alias("base")))
    played = applied_to_history(messages).select(F.col("artist_key").alias("name_key"), "seq")
    # the first plays of every name, pruned before the shuffle (group limit),
    # then the one that brings the count to the threshold
    w = Window.partitionBy("name_key").orderBy("seq")
    first = played.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= min_scrobbles)
    nth = (first.join(tracked, "name_key").filter(F.col("_rn") + F.col("base") == min_scrobbles)
           .select("name_key", F.col("seq").alias("reach_seq")))
    already = tracked.filter(F.col("base") >= min_scrobbles).select(
        "name_key", F.lit(None).cast(messages.schema["seq"].dataType.simpleString()).alias("reach_seq"))
    reach = few(land("promotion_reach", nth.unionByName(already)))
    valid = messages.filter(
        F.col("track_key").isNotNull() & (F.col("track_key") != "") &
        F.col("artist").isNotNull() & (F.col("artist") != "") &
        F.col("title").isNotNull() & (F.col("title") != "") &
        F.col("pending_enrichment").isNotNull() & ~F.col("pending_enrichment")
    ).select(F.col("artist_key").alias("name_key"), "seq", "played_at")
    hits = valid.join(reach, "name_key").filter(F.col("reach_seq").isNull() | (F.col("seq") >= F.col("reach_seq")))
    return hits.groupBy("name_key").agg(F.min_by("played_at", "seq").alias("promoted_at"))
