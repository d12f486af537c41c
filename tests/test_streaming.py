"""Batch == micro-batches, replay safety, and a real foreachBatch stream."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from encore.plans.stages import discovery_batch
from encore.sources import bindings
from encore.streaming.microbatch import parse_topic, process_batch, read_topic, start
from encore.streaming.state import SnapshotStore

CUTS = ["1997-01-01", "1999-01-01"]


def _chunks(msgs):
    ts = F.col("seq.ts")
    lo = None
    for c in CUTS + [None]:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (ts >= F.to_timestamp(F.lit(lo)))
        if c is not None:
            cond = cond & (ts < F.to_timestamp(F.lit(c)))
        yield msgs.filter(cond)
        lo = c


def _snap(res_hist, res_art, res_recs):
    h = sorted((r.track_key, tuple(r.seq)) for r in res_hist.collect())
    a = sorted((r.name_key, r.status, r.play_count, r.scrobble_count, tuple(r.genres or []), r.spotify_uri)
               for r in res_art.collect())
    rc = sorted((r.artist_id, round(r.score, 9), tuple(r.evidence_tracks)) for r in res_recs.collect())
    return h, a, rc


def test_micro_batches_equal_one_batch_and_replay(spark):
    msgs = bindings.enriched_plays(spark, SF0001)
    base = bindings.base_artists(spark, SF0001)
    one = discovery_batch(msgs, base, land=lambda name, df: df.cache())
    expected = _snap(one.history, one.artists, one.recommendations)

    store = SnapshotStore(spark, tempfile.mkdtemp(prefix="encore-store-", dir="/tmp"))
    out = None
    for i, chunk in enumerate(_chunks(msgs)):
        out = process_batch(store, chunk, i, base)
    assert _snap(out["history_all"], out["artists"], out["recommendations"]) == expected
    # each batch appended only the tracks it inserted
    sizes = [store.spark.read.parquet(f"{store.root}/history/batch_id={i}").count() for i in range(3)]
    assert sum(sizes) == one.history.count() and min(sizes) > 0

    # the topics hold the records of all batches, dead letters included
    for topic, want in (("listening.history", one.history), ("tracks.novel", one.novel_events), ("dead.letters", one.dlq)):
        records = read_topic(spark, store.root, topic)
        assert records.count() == want.count() and records.filter("value is null").count() == 0

    # replaying batch 1 then 2 (at-least-once delivery) changes nothing
    chunks = list(_chunks(msgs))
    process_batch(store, chunks[1], 1, base)
    out = process_batch(store, chunks[2], 2, base)
    assert _snap(out["history_all"], out["artists"], out["recommendations"]) == expected


def test_foreach_batch_stream_over_files(spark):
    root = tempfile.mkdtemp(prefix="encore-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    msgs = bindings.enriched_plays(spark, SF0001)
    for i, chunk in enumerate(_chunks(msgs)):
        chunk.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part={i}"))
    base = bindings.base_artists(spark, SF0001)
    stream = (spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    store = SnapshotStore(spark, os.path.join(root, "state"))
    q = start(spark, stream, store, base, os.path.join(root, "ckpt"))
    q.awaitTermination(600)
    one = discovery_batch(msgs, base, land=lambda name, df: df.cache())
    got = store.read_appended_before("history", 10 ** 9)
    assert sorted(r.track_key for r in got.collect()) == sorted(r.track_key for r in one.history.collect())


def test_parse_topic_routes_malformed(spark):
    broken = "{not json" + "x" * 10_000
    raw = spark.createDataFrame([('{"artist": "a", "title": "t"}',), (broken,)], "value string")
    ok, bad = parse_topic(raw, "artist string, title string")
    assert [tuple(r) for r in ok.collect()] == [("a", "t")]
    assert [tuple(r) for r in bad.collect()] == [("malformed_message", broken)]   # kept whole


def test_topic_sink_frame_is_keyed_json(spark):
    from encore.streaming.microbatch import topic_sink_frame
    df = spark.createDataFrame([("k1", "a", None)], "track_key string, artist string, mbid string")
    row = topic_sink_frame(df, "track_key").first()
    assert row.key == "k1"
    assert row.value == '{"track_key":"k1","artist":"a"}'  # nulls are left out, as the discovery events want
