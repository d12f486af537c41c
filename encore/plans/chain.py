"""The whole chain T2 -> T1 -> T3 -> T4 -> T5 as one batch job.

``raw`` is what the two raw topics hold, ``messages`` runs it through
normalisation and enrichment; ``build_state(..., "chain")`` takes it from
there to recommendations. The same stage functions are the bodies of the
consumer groups in ``encore.streaming.topology``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions.text import case_fold_key
from encore.operators.dedup import topic_union
from encore.operators.enrich import Answers, answers, enrich_from
from encore.plans.jobs import explore_top_tracks
from encore.plans.normalize import first_hits, normalize_stage
from encore.sources import bindings, chain, payloads
from encore.sources.bindings import EVENTS_AS_OF, PLAYS_AS_OF


@dataclass
class Lookups:
    """What the external services answered, one row per key."""

    hits: DataFrame
    found: Answers


def raw_tracks(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """Raw tracks of the top-track exploration (T6) over the landed artists, as
    of PLAYS_AS_OF; ``rank`` is kept beside the message, and so are the
    ``copies`` of ``folded`` ones (see ``explore_top_tracks``)."""
    tracks, _ = explore_top_tracks(bindings.base_artists(spark, sf_dir),
                                   payloads.read_top_tracks(payloads.top_track_payloads(spark, sf_dir)), PLAYS_AS_OF,
                                   folded=folded)
    at = F.to_timestamp_ntz(F.lit(PLAYS_AS_OF))
    seq = F.struct(at.alias("ts"), F.col("origin.origin_artist_id").alias("origin"),
                   F.lit(0).cast("long").alias("page"), F.col("rank").cast("long").alias("pos"))
    return chain.with_guests(tracks.select("source", "artist", "title", "artist_id", "track_id", "rank",
                                           *(["copies"] if folded else []), seq.alias("seq")))


def raw_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = payloads.play_page_payloads(spark, sf_dir)
    return payloads.raw_plays(payloads.read_play_pages(pages)).drop("external_ids", "raw")


def raw(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """Both raw topics."""
    return topic_union(raw_plays(spark, sf_dir), raw_tracks(spark, sf_dir, folded).drop("rank"))


def lookups(spark: SparkSession, sf_dir: str, land=lambda name, df: df) -> Lookups:
    """``land(name, df)`` keeps each table, so that streams look keys up
    instead of deriving the answers anew for every micro-batch."""
    rows = land("catalog", chain.catalog(spark, sf_dir, raw_tracks(spark, sf_dir, folded=True)))
    a = answers(chain.artist_meta(spark, sf_dir), chain.track_meta(rows), chain.artist_tags(spark, sf_dir),
                chain.track_tags(spark, sf_dir))
    return Lookups(land("hits", first_hits(rows)),
                   Answers(land("artist_answers", a.artists), land("track_answers", a.tracks),
                           land("artist_tags", a.artist_tags), land("track_tags", a.track_tags)))


def keyed_message(enriched: DataFrame) -> DataFrame:
    """An enriched message as the history and novelty stages read it."""
    return enriched.withColumn("artist_key", case_fold_key("artist")).withColumn("source", F.get("sources", F.lit(0)))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw topics -> normalized -> enriched messages. Raw tracks that several
    artist rows of one id send are one row with their number as ``copies``
    (null for plays)."""
    look = lookups(spark, sf_dir)
    normalized = normalize_stage(raw(spark, sf_dir, folded=True), hits=look.hits,
                                 processed_at=F.to_timestamp_ntz(F.lit(EVENTS_AS_OF)))
    return keyed_message(enrich_from(normalized, look.found))
