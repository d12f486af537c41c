"""The chain as consumer groups over durable topics.

    raw.plays, raw.tracks -> [normalizer] -> tracks.normalized -> [enricher] -> tracks.enriched
    tracks.enriched -> [history] -> listening.history, artist and history state
    tracks.enriched -> [novelty] -> tracks.novel, promotions
    tracks.novel    -> [scorer]  -> recommendation state
    history, novelty, scorer -> dead.letters

Every group is a streaming query with a checkpoint of its own; history and
novelty read the same topic independently of each other. Stopping, losing or
replaying one group leaves the others' offsets and state alone.

State. The ledger of applied messages (``dropDuplicates`` on the message id)
and the first delivery of every track (``applyInPandasWithState``) live in
RocksDB state stores: a batch looks up the keys of its own messages, and a
message that is delivered again, in the same or any later batch, changes
nothing. Artists, first-two tables and recommendations are ``KeyedTable``s: a
batch reads and rewrites the buckets of its own keys. History rows are
appended. A replayed batch gets the same messages and state, and overwrites
its own versions.

A message sees history rows strictly before it and the artist row after it
(both by ``seq``), however far the other group has come: the novelty group
keeps the first plays of artists, genres and tracks itself. Only the scorer
reads the history group's artist table, so ``drain`` runs the groups in the
order of the chain; in continuous operation a score can wait in the dead
letters for its artist, as an unknown one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from encore.functions.scoring import DEFAULT_WEIGHTS, ScoreWeights
from encore.operators import ordered
from encore.operators.dedup import topic_union
from encore.operators.enrich import enrich_from
from encore.plans.chain import Lookups, keyed_message
from encore.plans.normalize import normalize_stage, route_history
from encore.plans.stages import (AUTO_FOLLOW_PLAYS, NOVEL_EVENT_COLUMNS, dlq_rows, novelty_routes, score_events)
from encore.streaming.keyed import KeyedTable
from encore.streaming.state import SnapshotStore
from encore.streaming.topics import Topics, from_value, parsed

GROUPS = ("normalizer", "enricher", "history", "novelty", "scorer")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SEQ = "struct<ts:timestamp_ntz,origin:string,page:bigint,pos:bigint>"
RAW = f"source string, artist string, title string, played_at timestamp_ntz, seq {SEQ}"
NORMALIZED = ("track_key string, artist string, title string, artist_id string, track_id string, "
              f"sources array<string>, played boolean, played_at timestamp_ntz, seq {SEQ}, processed_at timestamp_ntz")
ENRICHED = NORMALIZED + (", genres array<string>, enrichment_source string, pending_enrichment boolean, "
                         "artist_popularity int, track_popularity int")
NOVEL = ("track_key string, artist string, artist_id string, genres array<string>, artist_popularity int, "
         "track_popularity int, played_at timestamp_ntz, track_is_new boolean, artist_is_new boolean, "
         f"new_genres array<string>, known_genres array<string>, genre_novelty_ratio double, seq {SEQ}")

SEEN = f"artist_key string, first_seq {SEQ}, scrobble_count bigint"
FIRST_TWO = "{key} string, s1 {seq}, t1 string, s2 {seq}, t2 string"
RECOMMENDATIONS = ("artist_id string, score double, score_breakdown struct<genre_novelty:double,popularity_norm:double>, "
                   "evidence_tracks array<string>, updated_at timestamp_ntz")
ARTISTS = ("id string, name string, name_key string, status string, high_priority boolean, origin_artist_id string, "
           "source string, last_explored_at timestamp_ntz, last_similar_explored_at timestamp_ntz, spotify_uri string, "
           "lastfm_mbid string, play_count bigint, scrobble_count bigint, genres array<string>, added_at timestamp_ntz")


def first_delivery(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Marks the message that is the first applied one of its track, and tells
    all messages of the track where it stands. State: that message's seq. A
    call holds one track's messages of one micro-batch."""
    got = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "origin", "page", "pos"], kind="stable",
                                                               ignore_index=True)
    first = state.get[0] if state.exists else None
    inserted = pd.Series(False, index=got.index)
    if first is None and got["applied"].any():
        at = int(got["applied"].to_numpy().argmax())
        first = got["message_id"].iloc[at]
        inserted.iloc[at] = True
        state.update((first,))
    yield pd.DataFrame({"value": got["value"], "inserted": inserted, "first_seq": first})


class Topology:
    """The consumer groups over the topics below ``root``."""

    def __init__(self, spark: SparkSession, root: str, lookups: Lookups, base_artists: DataFrame,
                 weights: ScoreWeights = DEFAULT_WEIGHTS, promote_at: int = AUTO_FOLLOW_PLAYS,
                 processed_at: F.Column | None = None, files: int | None = None, buckets: int = 64):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        self.spark, self.store, self.lookups = spark, SnapshotStore(spark, root), lookups
        self.topics, self.weights, self.promote_at, self.files = Topics(self.store), weights, promote_at, files
        self.processed_at = F.localtimestamp() if processed_at is None else processed_at

        def table(name: str, key: str, schema: str) -> KeyedTable:
            return KeyedTable(self.store, name, key, schema, buckets)

        self.artists = table("artists", "name_key", ARTISTS)
        self.seen = table("novelty_artists", "artist_key", SEEN)
        self.first2_artist = table("first2_artist", "artist_key", FIRST_TWO.format(key="artist_key", seq=SEQ))
        self.first2_genre = table("first2_genre", "genre", FIRST_TWO.format(key="genre", seq=SEQ))
        self.recommendations = table("recommendations", "artist_id", RECOMMENDATIONS)
        self.base = base_artists
        if not self.artists.manifest():
            self.artists.upsert(-1, ordered.upsert_artists(base_artists, self._no_counters()))

    def _no_counters(self) -> DataFrame:
        none = self.spark.createDataFrame([], ENRICHED)
        return ordered.artist_counters(keyed_message(none), keyed_message(none))

    # ------------------------------------------------------------ running
    def start(self, group: str, **trigger) -> StreamingQuery:
        """The group's query; ``availableNow`` unless a trigger is given."""
        writer = getattr(self, f"_{group}")()
        return (writer.queryName(f"{group}-{id(self)}").trigger(**(trigger or {"availableNow": True}))
                .option("checkpointLocation", f"{self.store.root}/checkpoints/{group}").start())

    def drain(self, groups: tuple[str, ...] = GROUPS) -> None:
        """Run the groups one after another over everything that waits for them."""
        for group in groups:
            self.start(group).awaitTermination()

    # ------------------------------------------------------------ stateless groups
    def _normalizer(self):
        raw = topic_union(*(parsed(self.topics.stream(t, ["ingest"], True, self.files), RAW)
                            .where("m is not null").select("m.*") for t in ("raw.plays", "raw.tracks")))
        out = normalize_stage(raw, hits=self.lookups.hits, processed_at=self.processed_at)
        return self.topics.sink(out, "tracks.normalized", "normalizer", "track_key")

    def _enricher(self):
        messages = parsed(self.topics.stream("tracks.normalized", ["normalizer"], False, self.files), NORMALIZED)
        out = enrich_from(messages.where("m is not null").select("m.*"), self.lookups.found)
        return self.topics.sink(out, "tracks.enriched", "enricher", "track_key")

    # ------------------------------------------------------------ groups with state
    def _deliveries(self) -> DataFrame:
        """Every enriched message once, with whether it is the first of its
        track and where that first one stands."""
        each = parsed(self.topics.stream("tracks.enriched", ["enricher"], False, self.files), ENRICHED)
        m = each.dropDuplicates(["message_id"]).where("m is not null").select("message_id", "value", "m.*")
        applied = F.col("track_key").isNotNull() & F.col("artist").isNotNull() & F.col("title").isNotNull() & \
            F.coalesce("played", F.lit(True))
        rows = m.select(F.coalesce("track_key", F.lit("")).alias("track_key"), "message_id", "value",
                        applied.alias("applied"), "seq.*")
        return rows.groupBy("track_key").applyInPandasWithState(
            first_delivery, "value string, inserted boolean, first_seq string", "first string", "append", "NoTimeout")

    def _landed(self, group: str, deliveries: DataFrame, batch_id: int) -> DataFrame:
        """The batch's messages, written once: the stateful operators above run
        once per batch whatever reads their rows."""
        read, first = from_value("value", ENRICHED), from_value("first_seq", SEQ)
        rows = deliveries.select(read.alias("m"), "inserted", first.alias("track_first")).select(
            "m.*", "inserted", "track_first")
        return self.store.append(f"inbox/{group}", batch_id, keyed_message(rows))

    def _each_batch(self, stream: DataFrame, apply: Callable[[DataFrame, int], None]):
        return stream.writeStream.foreachBatch(apply)

    def _history(self):
        return self._each_batch(self._deliveries(), self.apply_history)

    def apply_history(self, deliveries: DataFrame, batch_id: int) -> None:
        """T3 for one micro-batch."""
        messages = self._landed("history", deliveries, batch_id)
        inserted = self.store.append("history", batch_id, ordered.first_seen_history(messages.where("inserted")))
        counters = self.store.write("counters", batch_id, ordered.artist_counters(messages, inserted))
        known = self.artists.lookup(counters.select(F.col("artist_key").alias("name_key")), batch_id)
        self.artists.upsert(batch_id, ordered.upsert_artists(known, counters))
        plain = messages.drop("inserted", "track_first")
        self.topics.send("listening.history", "history", batch_id, ordered.applied_to_history(plain), "track_key")
        self._dead_letters("history", batch_id, dlq_rows(route_history(plain), "history", plain.columns))

    def _novelty(self):
        return self._each_batch(self._deliveries(), self.apply_novelty)

    def apply_novelty(self, deliveries: DataFrame, batch_id: int) -> None:
        """T4 for one micro-batch, from the group's own first-play state."""
        messages = self._landed("novelty", deliveries, batch_id)
        plain, inserted = messages.drop("inserted", "track_first"), messages.where("inserted")

        # artists by name: where their first applied message stands, and their plays before the batch
        before = self.seen.lookup(messages.select("artist_key").where("artist_key is not null"), batch_id)
        now = ordered.applied_to_history(plain).groupBy("artist_key").agg(
            F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("scrobble_count"))
        changed = before.join(now.select("artist_key"), "artist_key", "left_semi")
        self.seen.upsert(batch_id, topic_union(changed, now).groupBy("artist_key").agg(
            F.min("first_seq").alias("first_seq"), F.sum("scrobble_count").cast("long").alias("scrobble_count")))
        first = self.seen.lookup(messages.select("artist_key").where("artist_key is not null"), batch_id + 1)
        base = self.base.select(F.col("name_key").alias("artist_key"), "status")
        names = messages.select("artist_key").distinct()
        facts = self.store.write("novelty_facts", batch_id, (
            names.join(base, "artist_key", "left").join(first.select("artist_key", "first_seq"), "artist_key", "left")
            .join(before.select("artist_key", "scrobble_count"), "artist_key", "left")))

        f2_artist = self._first_two(self.first2_artist, batch_id, ordered.artist_rows(inserted),
                                    messages.select("artist_key"))
        f2_genre = self._first_two(self.first2_genre, batch_id, ordered.genre_rows(inserted),
                                   messages.select(F.explode("genres").alias("genre")))
        track_first = messages.where("track_first is not null").select("track_key", F.col("track_first").alias("seq")).distinct()

        known = F.col("status").isNotNull() | (F.col("first_seq") <= F.col("seq"))
        routed = novelty_routes(plain.join(facts.drop("scrobble_count"), "artist_key", "left"),
                                F.coalesce(known, F.lit(False))).drop("status", "first_seq")
        judged = ordered.novelty_signals(routed.where("route = 'ok'").drop("route"), f2_artist=f2_artist,
                                         f2_genre=f2_genre, track_first=track_first)
        events = self.store.append("novel_events", batch_id, judged.where(
            F.col("artist_is_new") | (F.size("new_genres") > 0)).select(*NOVEL_EVENT_COLUMNS))
        counts = facts.select(F.col("artist_key").alias("name_key"), F.coalesce("status", F.lit("TRACKED")).alias("status"),
                              F.coalesce("scrobble_count", F.lit(0)).cast("long").alias("scrobble_count"))
        self.store.append("promotions", batch_id, ordered.auto_promotions(plain, counts, self.promote_at))
        self.topics.send("tracks.novel", "novelty", batch_id, events, "track_key")
        self._dead_letters("novelty", batch_id, dlq_rows(routed, "novelty", plain.columns))

    def _first_two(self, table: KeyedTable, batch_id: int, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The first two history rows of the asked keys after this batch; the
        table is brought up to date for the keys that got new rows."""
        key = table.key
        asked = asked.where(F.col(key).isNotNull())
        old = table.lookup(asked, batch_id)
        long = topic_union(*(old.select(key, F.col(s).alias("seq"), F.col(t).alias("track_key")).where("seq is not null")
                             for s, t in (("s1", "t1"), ("s2", "t2"))), rows.select(key, "seq", "track_key"))
        merged = ordered.first_two(long, key)
        table.upsert(batch_id, merged.join(rows.select(key).distinct(), key, "left_semi"))
        return table.lookup(asked, batch_id + 1)

    def _scorer(self):
        events = parsed(self.topics.stream("tracks.novel", ["novelty", "import"], True, self.files), NOVEL)
        return self._each_batch(events.dropDuplicates(["message_id"]), self.apply_scores)

    def apply_scores(self, events: DataFrame, batch_id: int) -> None:
        """T5 for one micro-batch."""
        events = self.store.append("inbox/scorer", batch_id, events)
        scored = self.store.append("scored", batch_id, score_events(
            events.where("m is not null").select("m.*"), self.artists.read(), self.weights))
        good = scored.where("route = 'ok'")
        before = self.recommendations.lookup(good.select(F.col("rec_artist_id").alias("artist_id")), batch_id)
        self.recommendations.upsert(batch_id, ordered.best_score_with_evidence(good, before))
        self._dead_letters("scorer", batch_id, dlq_rows(scored, "scorer", NOVEL_EVENT_COLUMNS).unionByName(
            events.where("m is null").select(
                F.lit("scorer").alias("stage"), F.lit("malformed_message").alias("error_reason"),
                F.lit("the message cannot be decoded").alias("error_detail"), F.col("value").alias("original_payload"),
                F.lit(None).cast("timestamp_ntz").alias("failed_at"))))

    def _dead_letters(self, group: str, batch_id: int, rows: DataFrame) -> None:
        self.topics.send("dead.letters", group, batch_id, rows, "error_reason")

    # ------------------------------------------------------------ reading
    def history(self) -> DataFrame | None:
        return self.store.read_appended_before("history", 1 << 62)

    def artist_table(self) -> DataFrame:
        """The artists with their promotions."""
        promoted = self.store.read_appended_before("promotions", 1 << 62)
        if promoted is None:
            return self.artists.read()
        first = promoted.groupBy("name_key").agg(F.min("promoted_at").alias("promoted_at"))
        return ordered.apply_promotions(self.artists.read(), first).drop("promoted_at")
