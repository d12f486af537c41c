"""Registry of named queries: key -> (spark, sf_dir) -> DataFrame.

Every query reads the landed tables (or state tables Spark derives from them)
in full; result columns are flat (arrays joined to strings) and doubles
rounded to 6 places so the DuckDB oracle can hash-compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.plans import lists, stats, taste, windows
from encore.functions.text import id_from_uri, name_contains, normalize_text, track_key
from encore.operators.dedup import topic_union
from encore.operators.enrich import (backfill_artist_tags, bare_entity_id, enrich, enrichment_artist_tags,
                                    entity_id)
from encore.operators.objects import contains_value, merge_objects
from encore.operators.joins import artist_detail, artist_origin, light, rec_artist
from encore.operators.ordered import auto_promotions, novelty_signals
from encore.plans.jobs import (after_backfills, apply_status_decisions, backfill_entity_ids, backfill_genres, expand_similar,
                               explore_top_tracks, full_backfill, mark_similar_explored, onboard, replay_scores,
                               similar_candidates_judged)
from encore.functions.scoring import ScoreWeights
from encore.plans.normalize import normalize_stage, route_history, unfold
from encore.plans.stages import route_novelty
from encore.sources import bindings as b, payloads as p
from encore.sources.tables import read_table
from encore.sources.versions import HISTORY_VERSIONS, read_versions, write_version
from encore.streaming.state import advance_checkpoint, high_water_mark, pull_since
from encore.plans.build import build_state, land_rows, land_small
from encore.sources.bindings import EVENTS_AS_OF, PLAYS_AS_OF

# the name under which the play-history pulls keep their mark
PULL_SERVICE = "play-history"
# components of the feature vectors
TASTE_DIMS = 64

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c, sep: str = " | ") -> F.Column:
    return F.coalesce(F.array_join(F.col(c) if isinstance(c, str) else c, sep), F.lit(""))


def plays_state(spark, sf_dir):
    return build_state(spark, sf_dir, "plays")


def events_state(spark, sf_dir):
    return build_state(spark, sf_dir, "events")


def chain_state(spark, sf_dir):
    return build_state(spark, sf_dir, "chain")


# ---------------------------------------------------------------- flagship (O2 + J10 + J11)
@query("list_recommendations")
def q_list_recommendations(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    page = lists.list_recommendations(st.recommendations, st.artists, st.history, page=1, page_size=100)
    return page.select(
        "artist_id", "name", "status", "high_priority",
        r6("score").alias("score"),
        r6("score_breakdown.genre_novelty").alias("genre_novelty"),
        r6("score_breakdown.popularity_norm").alias("popularity_norm"),
        joined("evidence_labels").alias("evidence"),
        F.size("evidence_tracks").cast("bigint").alias("n_evidence"),
        "updated_at")


@query("list_recommendations_with_following")
def q_list_recommendations_following(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    page = lists.list_recommendations(st.recommendations, st.artists, st.history, page=1, page_size=100,
                                      include_following=True)
    return page.select("artist_id", "name", "status", r6("score").alias("score"),
                       joined("evidence_labels").alias("evidence"))


@query("list_recommendations_page_2")
def q_list_recommendations_page_2(spark, sf_dir):
    """O2/O3: the second page of ten, blacklisted artists out, followed ones in."""
    st = plays_state(spark, sf_dir)
    page = lists.list_recommendations(st.recommendations, st.artists, st.history, page=2, page_size=10,
                                      include_following=True)
    return page.select("artist_id", "name", "status", r6("score").alias("score"),
                       joined("evidence_labels").alias("evidence"))


@query("recommendation_total")
def q_recommendation_total(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    total = lists.recommendation_total(st.recommendations, st.artists)
    pages = F.when(F.col("total") > 0, F.ceil(F.col("total") / F.lit(lists.DEFAULT_PAGE_SIZE))).otherwise(0)
    return total.select("total", pages.cast("bigint").alias("pages"))


# ---------------------------------------------------------------- W1 / W6 outputs
@query("novel_events")
def q_novel_events(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    ev = st.novelty.filter(F.col("artist_is_new") | (F.size("new_genres") > 0))
    return ev.select("track_key", "artist", "title", "played_at", "artist_is_new", "track_is_new",
                     joined("genres").alias("genres"), joined("new_genres").alias("new_genres"),
                     joined("known_genres").alias("known_genres"),
                     r6("genre_novelty_ratio").alias("genre_novelty_ratio"))


@query("novelty_flags")
def q_novelty_flags(spark, sf_dir):
    """W1 over every judged message, aggregated per artist."""
    st = plays_state(spark, sf_dir)
    routed = route_novelty(st.messages, st.artists, light).filter(F.col("route") == "ok").drop("route")
    judged = novelty_signals(routed, st.history, land=lambda name, df: land_rows(df, name), few=light)
    return judged.groupBy("artist").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if("artist_is_new").alias("artist_new"),
        F.count_if("track_is_new").alias("track_new"),
        F.sum(F.size("new_genres")).cast("bigint").alias("new_genre_hits"),
        F.count_if(F.col("artist_is_new") | (F.size("new_genres") > 0)).alias("emitted"))


@query("scored_events")
def q_scored_events(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return st.scored.select("track_key", "artist", "played_at", F.col("rec_artist_id").alias("artist_id"),
                            "rec_high_priority", r6("score").alias("score"),
                            r6("breakdown.genre_novelty").alias("genre_novelty"),
                            r6("breakdown.popularity_norm").alias("popularity_norm"))


@query("scorer_run_counters")
def q_scorer_run_counters(spark, sf_dir):
    """A14 for the scorer: events by route, and the artists they scored."""
    st = plays_state(spark, sf_dir)
    return st.scored.agg(F.count_if(F.col("route") == "ok").alias("scored"),
                         F.count_if(F.col("route") == "validation_failed").alias("invalid"),
                         F.count_if(F.col("route") == "artist_not_found").alias("not_found"),
                         F.count_distinct(F.when(F.col("route") == "ok", F.col("rec_artist_id"))).alias("artists"))


@query("replay_recommendations")
def q_replay_recommendations(spark, sf_dir):
    """The landed novel events scored again with other weights."""
    st = plays_state(spark, sf_dir)
    again = replay_scores(st.novelty, st.artists, ScoreWeights(0.5, 0.5, 1.1))
    return again.select("artist_id", r6("score").alias("score"),
                        r6("score_breakdown.genre_novelty").alias("genre_novelty"),
                        r6("score_breakdown.popularity_norm").alias("popularity_norm"),
                        joined("evidence_tracks").alias("evidence_tracks"))


@query("best_score_with_evidence")
def q_best_scores(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return st.recommendations.select("artist_id", r6("score").alias("score"),
                                     r6("score_breakdown.genre_novelty").alias("genre_novelty"),
                                     r6("score_breakdown.popularity_norm").alias("popularity_norm"),
                                     joined("evidence_tracks").alias("evidence_tracks"), "updated_at")


# ---------------------------------------------------------------- state tables
@query("history_first_seen")
def q_history(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return st.history.select("track_key", "artist", "title", "played_at", joined("genres").alias("genres"),
                             "artist_popularity", "track_popularity", joined("sources").alias("sources"))


def history_of_versions(spark, sf_dir) -> DataFrame:
    """The history as files of three schema versions in one folder: a track
    is in the files of the version that its key falls to."""
    st = plays_state(spark, sf_dir)

    def write() -> DataFrame:
        path = f"{st.root}/history-by-version"
        first = F.substring("track_key", 1, 1)
        rows = st.history.withColumns({"popularity": F.col("artist_popularity"), "audio_features": F.lit("{}"),
                                       "pending_enrichment": F.lit(True)})
        shares = (first < "5", (first >= "5") & (first < "a"), first >= "a")
        for version, share in zip(HISTORY_VERSIONS, shares):
            write_version(rows.where(share), path, version)
        return read_versions(spark, path, HISTORY_VERSIONS)

    with st.lock:
        if "history-by-version" not in st.derived:
            st.derived["history-by-version"] = write()
        return st.derived["history-by-version"]


@query("history_mixed_versions")
def q_history_mixed_versions(spark, sf_dir):
    """Old and new history files read together."""
    return history_of_versions(spark, sf_dir).select(
        "track_key", "artist", "title", "played_at", joined("genres").alias("genres"), "artist_popularity",
        "track_popularity", "pending_enrichment", joined("sources").alias("sources"), "schema_version")


@query("artist_counters")
def q_artist_counters(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return st.artists.select("id", "name", "status", "play_count", "scrobble_count",
                             joined("genres").alias("genres"), "spotify_uri", "added_at")


# ---------------------------------------------------------------- lists
@query("list_artists")
def q_list_artists(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return lists.list_artists(st.artists, page=1, page_size=100).select(
        "id", "name", "status", "high_priority", "scrobble_count", joined("genres").alias("genres"),
        "source", "origin_artist_id", "origin_artist_name", "spotify_uri")


@query("list_artists_tracked_high_priority")
def q_list_artists_filtered(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return lists.list_artists(st.artists, status="TRACKED", high_priority=True, page=1, page_size=100).select(
        "id", "name", "scrobble_count", "origin_artist_name")


@query("recent_plays")
def q_recent_plays(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return lists.recent_plays(st.history).select("artist", "title", "played_at")


@query("eligible_top_tracks")
def q_eligible_top_tracks(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    older = F.to_timestamp_ntz(F.lit(PLAYS_AS_OF)) - F.make_interval(days=F.lit(7))
    return lists.exploration_queue(st.artists, "last_explored_at", older).select(
        "id", "name", "last_explored_at")


@query("eligible_similar")
def q_eligible_similar(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    older = F.to_timestamp_ntz(F.lit(PLAYS_AS_OF)) - F.make_interval(hours=F.lit(24))
    return lists.exploration_queue(st.artists, "last_similar_explored_at", older).select(
        "id", "name", "last_similar_explored_at")


# ---------------------------------------------------------------- statistics
@query("status_summary")
def q_status_summary(spark, sf_dir):
    return stats.status_summary(plays_state(spark, sf_dir).artists)


@query("genre_counts")
def q_genre_counts(spark, sf_dir):
    return stats.genre_counts(plays_state(spark, sf_dir).artists)


@query("score_distribution")
def q_score_distribution(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    d = stats.score_distribution(st.recommendations, st.artists)
    return d.select("total_scored", r6("min_score").alias("min_score"), r6("max_score").alias("max_score"),
                    r6("mean_score").alias("mean_score"), *[f"bucket_{i}" for i in range(5)])


@query("weekly_discoveries")
def q_weekly_discoveries(spark, sf_dir):
    return stats.weekly_discoveries(events_state(spark, sf_dir).artists, EVENTS_AS_OF)


@query("novelty_ratio")
def q_novelty_ratio(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return stats.novelty_ratio(st.history, st.artists, EVENTS_AS_OF).select("day", r6("ratio").alias("ratio"))


@query("artist_sources")
def q_artist_sources(spark, sf_dir):
    return stats.artist_sources(plays_state(spark, sf_dir).artists)


@query("play_velocity")
def q_play_velocity(spark, sf_dir):
    return stats.play_velocity(events_state(spark, sf_dir).history, EVENTS_AS_OF)


@query("breakdown_averages")
def q_breakdown_averages(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    d = stats.breakdown_averages(st.recommendations, st.artists)
    return d.select(r6("avg_genre_novelty").alias("avg_genre_novelty"),
                    r6("avg_popularity_norm").alias("avg_popularity_norm"), "total")


@query("exploration_coverage")
def q_exploration_coverage(spark, sf_dir):
    return stats.exploration_coverage(plays_state(spark, sf_dir).artists)


@query("status_funnel")
def q_status_funnel(spark, sf_dir):
    return stats.status_funnel(plays_state(spark, sf_dir).artists)


@query("high_priority_list")
def q_high_priority_list(spark, sf_dir):
    return stats.high_priority_list(plays_state(spark, sf_dir).artists)


@query("history_size")
def q_history_size(spark, sf_dir):
    return stats.history_size(plays_state(spark, sf_dir).history)


@query("pending_backlog")
def q_pending_backlog(spark, sf_dir):
    d = stats.pending_backlog(plays_state(spark, sf_dir).history)
    return d.select("pending", "total", r6("pending_rate").alias("pending_rate"))


@query("source_share")
def q_source_share(spark, sf_dir):
    return stats.source_share(plays_state(spark, sf_dir).artists)


@query("distinct_genres")
def q_distinct_genres(spark, sf_dir):
    """Sorted distinct genres over all artists (dashboard facets)."""
    a = plays_state(spark, sf_dir).artists
    return a.select(F.explode("genres").alias("genre")).distinct().orderBy("genre")


# ---------------------------------------------------------------- enrichment
def enriched_log(spark, sf_dir) -> DataFrame:
    """T1 over the play log. The services' answers are landed, so that by their
    size the log meets the small ones without a shuffle."""
    return enrich(b.normalized_plays(spark, sf_dir), b.artist_meta(spark, sf_dir), b.track_meta(spark, sf_dir),
                  b.artist_tag_lists(spark, sf_dir), b.track_tag_lists(spark, sf_dir), land=land_rows)


@query("enrich_chain")
def q_enrich_chain(spark, sf_dir):
    out = enriched_log(spark, sf_dir)
    return out.select("track_key", "artist", "title", "played_at", joined("genres").alias("genres"),
                      F.col("genres").isNull().alias("genres_null"),
                      "artist_popularity", "track_popularity", "enrichment_source", "pending_enrichment")


@query("enrichment_source_counts")
def q_enrichment_source_counts(spark, sf_dir):
    """A16-style shares of the enrichment outcome."""
    out = enriched_log(spark, sf_dir)
    return out.groupBy("enrichment_source").agg(F.count(F.lit(1)).alias("messages"),
                                                F.count_if(F.size("genres") > 0).alias("with_genres"))


# ---------------------------------------------------------------- payload sources
@query("raw_plays")
def q_raw_plays(spark, sf_dir):
    rp = p.raw_plays(p.read_play_pages(p.play_page_payloads(spark, sf_dir)))
    return rp.select("source", "artist", "title", "played_at",
                     F.col("external_ids")["lastfm_mbid"].alias("lastfm_mbid"))


@query("tag_payloads")
def q_tag_payloads(spark, sf_dir):
    parsed = p.tag_payloads(b.artist_tag_lists(spark, sf_dir)).select(
        "artist", p.read_tag_payload("payload").alias("tags"))
    return parsed.select("artist", F.size("tags").alias("n_tags"),
                         joined(enrichment_artist_tags("tags")).alias("enrichment_tags"),
                         joined(backfill_artist_tags("tags")).alias("backfill_tags"))


@query("similar_payloads")
def q_similar_payloads(spark, sf_dir):
    return p.read_similar_payload(p.similar_payloads(spark, sf_dir))


@query("followed_names")
def q_followed_names(spark, sf_dir):
    return p.read_followed(p.followed_payloads(spark, sf_dir))


@query("full_backfill")
def q_full_backfill(spark, sf_dir):
    """Every page is read, none is missing, and the newest play is the
    mark that is landed."""
    # the service answers once: everything below reads the answers it gave
    pages = land_rows(p.play_page_payloads(spark, sf_dir), "play-pages")
    plays, marks = full_backfill(pages, None, PULL_SERVICE, land=land_rows)
    mark = land_small(marks)
    return plays.agg(F.count(F.lit(1)).alias("pulled"), F.min("played_at").alias("first_pulled")).select(
        "pulled", "first_pulled", high_water_mark(mark, PULL_SERVICE).alias("checkpoint"),
        pages.select(F.count(F.lit(1))).scalar().alias("pages"), F.lit(PULL_SERVICE).alias("service"))


@query("incremental_pull")
def q_incremental_pull(spark, sf_dir):
    """A first pull up to a cut lands a high-water mark; the next pull
    takes only plays after it and advances the mark to max(played_at)."""
    plays = b.event_plays(spark, sf_dir)
    service = PULL_SERVICE
    first = plays.filter(F.col("played_at") < F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))
    # the mark is one row, landed by the first pull: the second reads it, not the log
    mark = land_small(advance_checkpoint(None, first, service))
    new_rows = pull_since(plays, mark, service)
    pulled = new_rows.agg(F.count(F.lit(1)).alias("pulled"), F.min("played_at").alias("first_pulled"),
                          F.max("played_at").alias("last_pulled"))
    return pulled.select("pulled", "first_pulled",
                         F.coalesce("last_pulled", high_water_mark(mark, service)).alias("checkpoint"),
                         F.lit(service).alias("service"))


# ---------------------------------------------------------------- artist jobs
def similar_outcomes(spark, sf_dir, st):
    """The expansion's outcomes, judged once per state for all its readers."""
    return st.shared("similar_outcomes", lambda: similar_candidates_judged(
        st.artists, p.read_similar_payload(p.similar_payloads(spark, sf_dir)), PLAYS_AS_OF))


@query("similar_expansion")
def q_similar_expansion(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return similar_outcomes(spark, sf_dir, st).select("origin_artist_name", "position", "name", "mbid", "outcome")


@query("expansion_run_counters")
def q_expansion_run_counters(spark, sf_dir):
    """A14 for the expansion job: candidates by outcome."""
    st = plays_state(spark, sf_dir)
    return similar_outcomes(spark, sf_dir, st).groupBy("outcome").agg(F.count(F.lit(1)).alias("candidates"))


@query("discovery_messages")
def q_discovery_messages(spark, sf_dir):
    """The events of the inserted artists, read back from their JSON."""
    st = plays_state(spark, sf_dir)
    similar = p.similar_payloads(spark, sf_dir)
    _, _, events, _ = expand_similar(st.artists, p.read_similar_payload(similar), PLAYS_AS_OF, answered=similar,
                                     outcomes=similar_outcomes(spark, sf_dir, st))
    fields = "artist_name string, source string, origin_artist_id string, origin_artist_name string, lastfm_mbid string"
    return events.select("key", F.from_json("value", fields).alias("v")).select("key", "v.*")


@query("discovered_from")
def q_discovered_from(spark, sf_dir):
    """Artists discovered through similar expansion with their origin."""
    st = plays_state(spark, sf_dir)
    similar = p.similar_payloads(spark, sf_dir)
    _, _, _, after = expand_similar(st.artists, p.read_similar_payload(similar), PLAYS_AS_OF, answered=similar,
                                    outcomes=similar_outcomes(spark, sf_dir, st))
    found = artist_origin(after.filter(F.col("source") == "LASTFM_SIMILAR"), after)
    return found.select("name", "origin_artist_name", "added_at").orderBy(F.col("added_at").desc(), "name")


@query("top_track_messages")
def q_top_track_messages(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    msgs, _ = explore_top_tracks(st.artists, p.read_top_tracks(p.top_track_payloads(spark, sf_dir)), PLAYS_AS_OF)
    return msgs.select("artist", "artist_id", "track_id", "title", "rank",
                       F.col("origin.origin_artist_id").alias("origin_artist_id"))


@query("onboarding")
def q_onboarding(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return onboard(st.artists, p.read_followed(p.followed_payloads(spark, sf_dir))).select(
        "id", "name", "status", "high_priority")


@query("status_counts_delta")
def q_status_counts_delta(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    after = onboard(st.artists, p.read_followed(p.followed_payloads(spark, sf_dir)))
    return stats.status_counts_delta(st.artists, after)


@query("status_decisions")
def q_status_decisions(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    after, _ = apply_status_decisions(st.artists, b.status_decisions(spark, sf_dir))
    return after.select("id", "name", "previous_status", "status", "decided_at")


@query("auto_promote")
def q_auto_promote(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return auto_promotions(st.messages, b.base_artists(spark, sf_dir).withColumn(
        "scrobble_count", F.lit(0).cast("bigint")), 3)


def backfill_artists(spark, sf_dir):
    """The landed artists: every third with genres, every third with an empty
    list, the others without; play counts by key."""
    a = b.base_artists(spark, sf_dir)
    key = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("_k"))
    genres = F.when(F.col("_k") % 3 == 1, F.array(F.lit("kept"))).when(
        F.col("_k") % 3 == 2, F.array().cast("array<string>"))
    return a.join(key, "name").withColumns({"genres": genres, "play_count": (F.col("_k") * 37 % 101).cast("bigint")}) \
        .drop("_k")


@query("backfill_genres")
def q_backfill_genres(spark, sf_dir):
    out = backfill_genres(backfill_artists(spark, sf_dir), b.artist_tag_lists(spark, sf_dir))
    return out.select("id", "name", joined("genres").alias("genres"), "outcome")


@query("backfill_entity_ids")
def q_backfill_entity_ids(spark, sf_dir):
    return backfill_entity_ids(backfill_artists(spark, sf_dir), b.artist_search(spark, sf_dir))


@query("artists_after_backfills")
def q_artists_after_backfills(spark, sf_dir):
    """The artist table after both backfills."""
    artists = backfill_artists(spark, sf_dir)
    after = after_backfills(artists, backfill_genres(artists, b.artist_tag_lists(spark, sf_dir)),
                            backfill_entity_ids(artists, b.artist_search(spark, sf_dir)))
    return after.select("id", "name", "status", joined("genres").alias("genres"), "spotify_uri", "play_count")


# ---------------------------------------------------------------- scalar functions
@query("normalize_documents")
def q_normalize_documents(spark, sf_dir):
    """F1/F2 over whole document texts: normalized length and track key of
    (source, text)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return d.select("doc_id", F.length(normalize_text("text")).alias("norm_chars"),
                    track_key(F.col("source"), F.col("text")).alias("key"))


@query("artist_ids")
def q_artist_ids(spark, sf_dir):
    a = plays_state(spark, sf_dir).artists
    return a.select("id", "name", "spotify_uri", id_from_uri("spotify_uri").alias("uri_id"),
                    entity_id("spotify_uri", "artist").alias("valid_id"),
                    bare_entity_id("spotify_uri").alias("bare_id"))


@query("service_health")
def q_service_health(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    ckpts = None
    for source in ("lastfm", "spotify"):
        ckpts = advance_checkpoint(ckpts, st.messages.filter(F.col("source") == source), f"{source}-ingester")
    return stats.service_health(ckpts, PLAYS_AS_OF)


# ---------------------------------------------------------------- detail / search
@query("artist_detail")
def q_artist_detail(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    d = artist_detail(st.artists, st.recommendations)
    return d.select("id", "name", "status", "play_count", "scrobble_count",
                    r6("recommendation.score").alias("score"),
                    r6("recommendation.score_breakdown.genre_novelty").alias("genre_novelty"),
                    F.when(F.col("recommendation").isNotNull(), F.size("recommendation.evidence_tracks"))
                    .cast("bigint").alias("n_evidence"))


@query("rec_by_artist_name")
def q_rec_by_artist_name(spark, sf_dir):
    st = plays_state(spark, sf_dir)
    return (rec_artist(st.recommendations, st.artists)
            .filter(F.col("name_key") == F.lower(F.lit("Supplier#000000002")))
            .select("artist_id", "name", r6("score").alias("score")))


@query("search_artists")
def q_search_artists(spark, sf_dir):
    a = plays_state(spark, sf_dir).artists
    return a.filter(name_contains("name", "r#00000001")).select("id", "name").orderBy("name")


@query("genre_filter")
def q_genre_filter(spark, sf_dir):
    a = plays_state(spark, sf_dir).artists
    return a.filter(F.array_contains("genres", "promo")).select("id", "name", joined("genres").alias("genres"))


@query("run_counters")
def q_run_counters(spark, sf_dir):
    """Novelty-stage tallies of one run."""
    st = plays_state(spark, sf_dir)
    routed = route_novelty(st.messages, st.artists, light)
    emitted = st.novelty.select(F.lit("processed").alias("k"), F.lit(-1).alias("w"))
    kinds = (routed.select(F.col("route").alias("k"), F.lit(1).alias("w"))
             .unionByName(emitted)
             .unionByName(st.dlq.filter(F.col("stage") == "novelty")
                          .select(F.lit("failed_dlq").alias("k"), F.lit(1).alias("w"))))
    # ok-routed messages minus the emitted ones are the skipped-without-novelty
    out = kinds.agg(
        F.count_if(F.col("k") == "processed").alias("processed"),
        F.count_if(F.col("k") == "skipped_pending").alias("skipped_pending"),
        F.coalesce(F.sum(F.when(F.col("k").isin("ok", "processed"), F.col("w"))), F.lit(0)).cast("bigint")
        .alias("skipped_no_novelty"),
        F.count_if(F.col("k") == "failed_dlq").alias("failed_dlq"))
    return out


# ---------------------------------------------------------------- normalize stage
@query("normalize_stage")
def q_normalize_stage(spark, sf_dir):
    plays = p.raw_plays(p.read_play_pages(p.play_page_payloads(spark, sf_dir)))
    # The normalizer consumes raw plays and the raw tracks that top-track
    # exploration produces (their ids are ignored and re-resolved)
    tracks, _ = explore_top_tracks(plays_state(spark, sf_dir).artists,
                                   p.read_top_tracks(p.top_track_payloads(spark, sf_dir)), PLAYS_AS_OF, folded=True)
    raw = topic_union(plays.drop("external_ids", "raw", "seq"),
                      tracks.select("source", "artist", "title", "artist_id", "track_id", "copies"))
    # equal messages of artists that share an id are looked up once
    out = unfold(normalize_stage(raw, b.track_catalog(spark, sf_dir)))
    return out.select("track_key", "artist", "title", "artist_id", "track_id", joined("sources").alias("sources"),
                      "played", "played_at")


# ---------------------------------------------------------------- dashboard tiles
@query("avg_plays_per_day")
def q_avg_plays_per_day(spark, sf_dir):
    """round(total plays over the 30-day window / 30)."""
    v = stats.play_velocity(events_state(spark, sf_dir).history, EVENTS_AS_OF)
    return v.agg(F.round(F.sum("plays") / 30).cast("bigint").alias("avg_plays_per_day"),
                 F.sum("plays").cast("bigint").alias("total_plays"))


@query("funnel_bar_base")
def q_funnel_bar_base(spark, sf_dir):
    """The largest funnel total, at least 1."""
    f = stats.status_funnel(plays_state(spark, sf_dir).artists)
    return f.agg(F.greatest(F.max("total"), F.lit(1)).cast("bigint").alias("bar_base"))


@query("score_readout")
def q_score_readout(spark, sf_dir):
    """Score as an integer percentage per recommended artist."""
    st = plays_state(spark, sf_dir)
    return st.recommendations.select("artist_id", F.round(F.col("score") * 100).cast("int").alias("score_pct"))


@query("day_labels")
def q_day_labels(spark, sf_dir):
    """Velocity days labelled D-k (k days before the as-of day)."""
    v = stats.play_velocity(events_state(spark, sf_dir).history, EVENTS_AS_OF)
    k = F.datediff(F.to_date(F.lit(EVENTS_AS_OF)), F.col("day"))
    return v.select("day", F.concat(F.lit("D-"), k.cast("string")).alias("label"), "plays")


@query("dlq_rate")
def q_dlq_rate(spark, sf_dir):
    """Share of messages routed to the DLQ in one run."""
    st = plays_state(spark, sf_dir)
    kinds = (st.messages.select(F.lit(1).alias("m"), F.lit(0).alias("d"))
             .unionByName(st.dlq.select(F.lit(0).alias("m"), F.lit(1).alias("d"))))
    return kinds.agg(F.sum("m").cast("bigint").alias("messages"), F.sum("d").cast("bigint").alias("dlq"),
                     F.round(F.coalesce(F.sum("d") / F.sum("m"), F.lit(0.0)), 6).alias("dlq_rate"))


@query("explored_after_jobs")
def q_explored_after_jobs(spark, sf_dir):
    """Exploration timestamps after the top-track (T6) and similar
    jobs ran at the as-of time."""
    st = plays_state(spark, sf_dir)
    tops, similar = p.top_track_payloads(spark, sf_dir), p.similar_payloads(spark, sf_dir)
    _, after6 = explore_top_tracks(st.artists, p.read_top_tracks(tops), PLAYS_AS_OF, answered=tops)
    # the marks depend on the answers that came, not on what the expansion inserts
    return mark_similar_explored(after6, similar, PLAYS_AS_OF).select(
        "id", "name", "last_explored_at", "last_similar_explored_at")


@query("dlq_rows")
def q_dlq_rows(spark, sf_dir):
    """The dead letters of all stages by reason, read back from their
    whole payloads."""
    d = plays_state(spark, sf_dir).dlq
    seq = F.from_json("original_payload", "seq struct<l_orderkey:long,l_linenumber:int>")["seq"]
    return d.select("stage", "error_reason", "error_detail", seq["l_orderkey"].alias("order_key"),
                    seq["l_linenumber"].cast("int").alias("line_number"), "failed_at")


@query("breakdown_averages_json")
def q_breakdown_averages_json(spark, sf_dir):
    """A8 over the breakdown kept as JSON text (F9/F10 at the storage edge):
    only rows whose object has both keys count."""
    st = plays_state(spark, sf_dir)
    recs = st.recommendations.withColumn("score_breakdown", F.to_json("score_breakdown"))
    return stats.breakdown_averages_json(recs, st.artists).select(
        r6("avg_genre_novelty").alias("avg_genre_novelty"),
        r6("avg_popularity_norm").alias("avg_popularity_norm"), "total")


@query("history_run_counters")
def q_history_run_counters(spark, sf_dir):
    """A14 for the history stage: P3/P4 routes of every message, applied
    messages split into inserted (first delivery) and already seen."""
    st = plays_state(spark, sf_dir)
    routed = route_history(st.messages.select("track_key", "artist", "title", "played", "seq"))
    first = st.history.select("track_key", F.col("seq").alias("_first"))
    r = routed.join(first, "track_key", "left")
    applied = F.col("route") == "apply"
    return r.agg(F.count_if(applied & (F.col("seq") == F.col("_first"))).alias("inserted"),
                 F.count_if(applied & (F.col("seq") != F.col("_first"))).alias("already_seen"),
                 F.count_if(F.col("route") == "skipped_not_played").alias("skipped"),
                 F.count_if(F.col("route") == "dropped").alias("dropped"),
                 F.count_if(F.col("route") == "NULL_TRACK_KEY").alias("dlq"))


# ---------------------------------------------------------------- the whole chain (T2 -> T1 -> T3 -> T4 -> T5)
@query("chain_messages")
def q_chain_messages(spark, sf_dir):
    """T2 -> T1 over both raw topics."""
    return unfold(chain_state(spark, sf_dir).messages).select(
        "track_key", "artist", "title", "artist_id", "track_id", joined("sources").alias("sources"), "played",
        "played_at", "processed_at", joined("genres").alias("genres"), "artist_popularity", "track_popularity",
        "enrichment_source", "pending_enrichment")


@query("chain_artists")
def q_chain_artists(spark, sf_dir):
    """T3 at the end of the chain: landed artists and those the plays brought."""
    return chain_state(spark, sf_dir).artists.select(
        "id", "name", "status", "play_count", "scrobble_count", joined("genres").alias("genres"), "spotify_uri",
        "added_at")


@query("chain_recommendations")
def q_chain_recommendations(spark, sf_dir):
    """Raw pages to recommendations."""
    st = chain_state(spark, sf_dir)
    return rec_artist(st.recommendations, st.artists).select(
        "artist_id", "name", "status", r6("score").alias("score"),
        r6("score_breakdown.genre_novelty").alias("genre_novelty"),
        r6("score_breakdown.popularity_norm").alias("popularity_norm"),
        joined("evidence_tracks").alias("evidence_tracks"), "updated_at")


@query("chain_dead_letters")
def q_chain_dead_letters(spark, sf_dir):
    """S7 over the chain: artists without a row, bad ratios and artists that
    cannot be found, with the message's artist out of its payload."""
    return unfold(chain_state(spark, sf_dir).dlq).select(
        "stage", "error_reason", "error_detail", F.get_json_object("original_payload", "$.artist").alias("artist"),
        F.get_json_object("original_payload", "$.track_key").alias("track_key"), "failed_at")


@query("chain_run_counters")
def q_chain_run_counters(spark, sf_dir):
    """A14 over the chain: messages by stage and route."""
    st = chain_state(spark, sf_dir)
    novelty = route_novelty(st.messages, st.artists, light)
    copies = F.coalesce("copies", F.lit(1)).alias("copies")
    routes = [route_history(st.messages).select(F.lit("history").alias("stage"), "route", copies),
              novelty.select(F.lit("novelty").alias("stage"), "route", copies),
              st.novelty.select(F.lit("novelty").alias("stage"), F.lit("emitted").alias("route"), copies),
              st.scored.select(F.lit("scorer").alias("stage"), "route", copies)]
    return topic_union(*routes).groupBy("stage", "route").agg(F.sum("copies").alias("messages"))


# ---------------------------------------------------------------- objects
@query("external_id_merge")
def q_external_id_merge(spark, sf_dir):
    """Of every external id of an artist the last one that came, kept as a
    map: the tracks' mbids on the plays, and the artist ids found for them."""
    plays = p.raw_plays(p.read_play_pages(p.play_page_payloads(spark, sf_dir)))
    found = chain_state(spark, sf_dir).messages
    rows = (plays.select("artist", "external_ids", "seq").unionByName(
        found.where("played").select("artist", F.create_map(F.lit("spotify"), "artist_id").alias("external_ids"), "seq")))
    ids = merge_objects(rows.withColumn("artist_key", F.lower("artist")), "artist_key", "external_ids")
    return ids.select("artist_key", F.size("external_ids").alias("n_ids"),
                      F.try_element_at("external_ids", F.lit("lastfm_mbid")).alias("lastfm_mbid"),
                      F.try_element_at("external_ids", F.lit("spotify")).alias("spotify"))


@query("object_containment")
def q_object_containment(spark, sf_dir):
    """which of the raw track objects contain a given object, per artist."""
    plays = p.raw_plays(p.read_play_pages(p.play_page_payloads(spark, sf_dir)))
    has = lambda wanted: F.count_if(contains_value(F.col("object"), wanted))
    return plays.select("artist", F.try_parse_json("raw").alias("object")).groupBy("artist").agg(
        has({"name": "click"}).alias("clicks"), has({"artist": {"mbid": ""}, "mbid": ""}).alias("without_mbid"),
        has({"artist": {"#text": "u1"}, "name": "error"}).alias("errors_of_u1"), has({"date": {}}).alias("dated"),
        has({"name": 1}).alias("never"))


# ---------------------------------------------------------------- windows and taste
@query("plays_per_period")
def q_plays_per_period(spark, sf_dir):
    """Plays per hour, day and week."""
    plays = b.event_plays(spark, sf_dir)
    return topic_union(*(windows.plays_per_period(plays, period) for period in windows.PERIODS))


@query("novel_ratio_per_week")
def q_novel_ratio_per_week(spark, sf_dir):
    """Share of the judged messages that were novel, per week."""
    st = chain_state(spark, sf_dir)
    judged = route_novelty(st.messages, st.artists).where("route = 'ok'")
    return windows.novel_ratio_per_period(unfold(judged), unfold(st.novelty), "week").select(
        "start", "messages", "novel", r6("ratio").alias("ratio"))


@query("new_genres_per_month")
def q_new_genres_per_month(spark, sf_dir):
    """Genres by the month of the first play that brought them."""
    return windows.new_genres_per_month(plays_state(spark, sf_dir).history)


@query("taste_distance")
def q_taste_distance(spark, sf_dir):
    """Distance of every vector to the mean vector of its label."""
    tracks = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return taste.taste_distance(tracks, "label", "embedding", TASTE_DIMS).select(
        "vec_id", "label", r6("distance").alias("distance"))
