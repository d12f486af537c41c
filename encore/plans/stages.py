"""Composite stages (T1-T5) as pure DataFrame functions.

``discovery_batch`` chains history -> artists -> novelty -> scoring -> best
score for one batch of enriched play messages, given the state tables before
the batch. The same function is the batch job (whole log, empty state) and the
body of a streaming ``foreachBatch`` (one micro-batch, previous snapshot).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.scoring import DEFAULT_WEIGHTS, ScoreWeights, artist_score, score_breakdown, valid_ratio
from encore.operators import ordered
from encore.operators.joins import artist_lookup, as_it_is
from encore.plans.normalize import route_history

NOVEL_EVENT_COLUMNS = ["track_key", "artist", "artist_id", "genres", "artist_popularity",
                       "track_popularity", "played_at", "track_is_new", "artist_is_new",
                       "new_genres", "known_genres", "genre_novelty_ratio", "seq"]


# plays after which a tracked artist is followed
AUTO_FOLLOW_PLAYS = 3


@dataclass
class BatchResult:
    history: DataFrame
    artists: DataFrame
    novelty: DataFrame          # every message routed by the novelty stage
    novel_events: DataFrame     # emitted tracks.novel events
    scored: DataFrame           # novel events with resolved artist and score
    recommendations: DataFrame
    dlq: DataFrame


def route_novelty(messages: DataFrame, artists: DataFrame,
                  few: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """P5: malformed -> DLQ, pending -> skipped, unknown artist -> DLQ.
    ``few`` marks lookups that fit for a broadcast."""
    # one row per name: artist rows that share a name must not multiply the messages
    known = few(artists.select(F.col("name_key").alias("artist_key")).distinct()).withColumn("_known", F.lit(True))
    return novelty_routes(messages.join(known, "artist_key", "left"), F.col("_known").isNotNull()).drop("_known")


def novelty_routes(messages: DataFrame, known: Column) -> DataFrame:
    """P5 for messages whose artist is known where ``known`` says so."""
    nonempty = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    valid = nonempty("track_key") & nonempty("artist") & nonempty("title") & \
        F.col("pending_enrichment").isNotNull()
    return messages.withColumn("route", F.when(~valid, F.lit("malformed_message"))
                               .when(F.col("pending_enrichment"), F.lit("skipped_pending"))
                               .when(~known, F.lit("artist_record_missing")).otherwise(F.lit("ok")))


def score_events(novel: DataFrame, artists: DataFrame, weights: ScoreWeights = DEFAULT_WEIGHTS) -> DataFrame:
    """P6 + J6 + F6: validate, resolve the artist, compute score and breakdown."""
    resolved = artist_lookup(novel, artists)
    ratio = F.col("genre_novelty_ratio")
    return (resolved
            .withColumn("route", F.when(F.col("track_key").isNull(), F.lit("validation_failed"))
                        .when(F.col("artist").isNull(), F.lit("validation_failed"))
                        .when(~valid_ratio(ratio), F.lit("validation_failed"))
                        .when(F.col("rec_artist_id").isNull(), F.lit("artist_not_found"))
                        .otherwise(F.lit("ok")))
            .withColumn("score", artist_score(ratio, F.col("artist_popularity"), F.col("rec_high_priority"), weights))
            .withColumn("breakdown", score_breakdown(ratio, F.col("artist_popularity"), weights)))


def _missing(c: str):
    return F.col(c).isNull() | (F.col(c) == "")


# (stage, reason) -> what the envelope says about the row
DLQ_DETAILS = {
    ("history", "NULL_TRACK_KEY"): lambda: F.lit("the track key is missing"),
    ("novelty", "malformed_message"): lambda: F.concat(F.lit("missing: "), F.concat_ws(
        ", ", *[F.when(_missing(c), F.lit(c)) for c in ("track_key", "artist", "title")],
        F.when(F.col("pending_enrichment").isNull(), F.lit("pending_enrichment")))),
    ("novelty", "artist_record_missing"): lambda: F.concat(F.lit("no artist row for "), F.col("artist")),
    ("scorer", "validation_failed"): lambda: F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("track_key", "artist")],
        F.lit("genre_novelty_ratio is not between 0 and 1")),
    ("scorer", "artist_not_found"): lambda: F.concat(F.lit("no artist row for "), F.col("artist")),
}
NO_ERROR = ("ok", "apply", "dropped", "skipped_pending", "skipped_not_played")


def dlq_rows(df: DataFrame, stage: str, payload: list[str] | None = None) -> DataFrame:
    """Error envelope of the rows whose route is an error reason, with the
    whole message (``payload`` columns) so that it can be replayed."""
    payload = [c for c in payload or df.columns if c not in ("route", "copies")]
    detail = F.lit(None).cast("string")
    for (at, reason), text in DLQ_DETAILS.items():
        if at == stage:
            detail = F.when(F.col("route") == reason, text()).otherwise(detail)
    return df.filter(~F.col("route").isin(*NO_ERROR)).select(
        F.lit(stage).alias("stage"),
        F.col("route").alias("error_reason"),
        detail.alias("error_detail"),
        F.to_json(F.struct(*payload)).alias("original_payload"),
        F.col("seq.ts").alias("failed_at"),
        *copies_of(df))


def copies_of(df: DataFrame) -> list[str]:
    """The column that counts the equal messages a folded row stands for, if there is one."""
    return ["copies"] if "copies" in df.columns else []


def keep_lazy(name: str, df: DataFrame) -> DataFrame:
    return df


def discovery_batch(messages: DataFrame, artists_state: DataFrame,
                    history_state: DataFrame | None = None,
                    recs_state: DataFrame | None = None,
                    weights: ScoreWeights = DEFAULT_WEIGHTS,
                    land: Callable[[str, DataFrame], DataFrame] = keep_lazy,
                    first2_state: tuple[DataFrame, DataFrame] | None = None,
                    promote_at: int = AUTO_FOLLOW_PLAYS,
                    imported: DataFrame | None = None,
                    fits: Callable[[DataFrame], bool] | None = None) -> BatchResult:
    """One batch through T3 (history + artists) -> T4 (novelty) -> T5 (scores).

    ``land(name, df)`` materialises a state table and returns what later
    steps read: the identity (lazy, one plan), a parquet table in the
    checkpoint folder (batch build) or a snapshot (micro-batch). Each landed
    table cuts the lineage of the steps after it.

    With ``history_state`` (all history rows before this batch) the work is
    incremental: ``land("history", ...)`` receives only the rows this batch
    inserts (an append), the first-two tables are merged from
    ``first2_state`` (artist rows, genre rows) and the new rows, and track
    lookups touch only this batch's keys. ``BatchResult.history`` is then the
    lazy union of the previous and the new rows.

    Artists that a message of this batch promotes (W7/U4) are landed as
    FOLLOWING: the promotion is part of the novelty stage and reads only the
    counters, so it is applied before the one write of the artist table.

    ``imported``: novel events that another producer put into the topic; they
    are scored together with those of this batch.

    Messages that were not played may come folded: ``copies`` equal ones as one
    row. Novel events, scores and dead letters of such rows carry the number on.

    ``fits`` counts a landed lookup: one that fits goes to the log, so that the
    log is not shuffled for it.
    """
    few = as_it_is if fits is None else lambda df: F.broadcast(df) if fits(df) else df
    batch_first = ordered.first_seen_history(messages, land=land, fits=fits)
    if history_state is None:
        inserted = land("history", batch_first)
        history = inserted
        track_first = history.select("track_key", "seq")
        prev_artist_rows = prev_genre_rows = None
    else:
        # which of this batch's tracks were already known (scan of the state
        # restricted to the batch keys), and the ones it inserts
        known = history_state.select("track_key", "seq").join(batch_first.select("track_key"), "track_key",
                                                              "left_semi")
        inserted = land("history", batch_first.join(known.select("track_key"), "track_key", "left_anti"))
        history = history_state.unionByName(inserted.select(*history_state.columns))
        track_first = known.unionByName(inserted.select("track_key", "seq"))
        if first2_state is None:
            first2_state = (ordered.first_two_rows(ordered.artist_rows(history_state), "artist_key"),
                            ordered.first_two_rows(ordered.genre_rows(history_state), "genre"))
        prev_artist_rows, prev_genre_rows = first2_state

    counters = ordered.artist_counters(messages, inserted)
    upserted = ordered.upsert_artists(artists_state, counters)
    promoted = ordered.auto_promotions(messages, ordered.counts_before(artists_state, counters), promote_at, land, few)
    artists = land("artists", ordered.apply_promotions(upserted, promoted).drop("promoted_at"))

    new_artist_rows = ordered.artist_rows(inserted)
    new_genre_rows = ordered.genre_rows(inserted)
    if prev_artist_rows is not None:
        new_artist_rows = prev_artist_rows.select(*new_artist_rows.columns).unionByName(new_artist_rows)
        new_genre_rows = prev_genre_rows.select(*new_genre_rows.columns).unionByName(new_genre_rows)
    f2_artist_rows = land("first2_artist", ordered.first_two_rows(new_artist_rows, "artist_key"))
    f2_genre_rows = land("first2_genre", ordered.first_two_rows(new_genre_rows, "genre"))

    routed = route_novelty(messages, artists, few)
    judged = ordered.novelty_signals(
        routed.filter(F.col("route") == "ok").drop("route"),
        f2_artist=ordered.pivot_first_two(f2_artist_rows, "artist_key"),
        f2_genre=ordered.pivot_first_two(f2_genre_rows, "genre"),
        track_first=track_first, land=land, few=few)
    emitted = F.col("artist_is_new") | (F.size("new_genres") > 0)
    novel_events = land("novel_events", judged.filter(emitted))

    to_score = novel_events.select(*NOVEL_EVENT_COLUMNS, *copies_of(messages))
    if imported is not None:
        to_score = to_score.unionByName(imported.select(*NOVEL_EVENT_COLUMNS), allowMissingColumns=True)
    scored = land("scored", score_events(to_score, artists, weights))
    recs = land("recommendations",
                ordered.best_score_with_evidence(scored.filter(F.col("route") == "ok"), recs_state))
    dlq = land("dlq", dlq_rows(route_history(messages), "history", messages.columns)
               .unionByName(dlq_rows(routed, "novelty", messages.columns))
               .unionByName(dlq_rows(scored, "scorer", NOVEL_EVENT_COLUMNS)))
    return BatchResult(history, artists, judged, novel_events, scored, recs, dlq)
