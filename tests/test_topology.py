"""The chain as consumer groups: equal to the batch job, through a crash of
one group, a repeated delivery and replays; and the keyed state tables."""

import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SF0001
from encore.plans import chain
from encore.plans.build import build_state
from encore.sources import bindings
from encore.sources import chain as inputs
from encore.sources.bindings import EVENTS_AS_OF
from encore.streaming.keyed import KeyedTable
from encore.streaming.state import SnapshotStore
from encore.streaming.topology import Topology

CUTS = ["2024-01-12", "2024-01-20"]


def scratch(name):
    return tempfile.mkdtemp(prefix=f"encore-{name}-", dir="/tmp")


def snap(history, artists, recs):
    h = sorted((r.track_key, tuple(r.seq), tuple(r.sources)) for r in history.collect())
    a = sorted((r.name_key, r.name, r.status, r.play_count, r.scrobble_count, tuple(r.genres or []), r.spotify_uri,
                str(r.added_at)) for r in artists.collect())
    rc = sorted((r.artist_id, round(r.score, 9), tuple(r.evidence_tracks), str(r.updated_at)) for r in recs.collect())
    return h, a, rc


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if "/state" not in d)


@pytest.fixture(scope="module")
def batch(spark):
    return build_state(spark, SF0001, "chain")


@pytest.fixture(scope="module")
def raw(spark):
    root = scratch("raw")
    chain.raw(spark, SF0001).write.parquet(f"{root}/raw")
    rows = spark.read.parquet(f"{root}/raw")
    bounds = [None, *CUTS, None]
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        part = rows
        if lo:
            part = part.where(F.col("seq.ts") >= F.to_timestamp_ntz(F.lit(lo)))
        if hi:
            part = part.where(F.col("seq.ts") < F.to_timestamp_ntz(F.lit(hi)))
        out.append(part)
    return out


def test_groups_equal_the_batch_job_through_crash_and_redelivery(spark, batch, raw, monkeypatch):
    root = scratch("topology")
    look = chain.lookups(spark, SF0001, lambda name, df: (df.write.parquet(f"{root}/lookups/{name}"),
                                                          spark.read.parquet(f"{root}/lookups/{name}"))[1])
    topo = Topology(spark, f"{root}/t", look, bindings.base_artists(spark, SF0001),
                    processed_at=F.to_timestamp_ntz(F.lit(EVENTS_AS_OF)), buckets=8)

    def send(batch_id, rows):
        for topic, source in (("raw.plays", "lastfm"), ("raw.tracks", "spotify")):
            topo.topics.send(topic, "ingest", batch_id, rows.where(F.col("source") == source), "artist")

    # no micro-batch reads the appended history
    monkeypatch.setattr(SnapshotStore, "read_appended_before", lambda *a: pytest.fail("history was scanned"))
    topo.topics.send("tracks.novel", "import", 0, inputs.imported_novel(spark, SF0001), "track_key")
    send(0, raw[0])
    topo.drain()

    # the novelty group dies after it wrote its state and before its batch is done
    send(1, raw[1])
    topo.drain(("normalizer", "enricher", "history"))
    others = [files_below(f"{root}/t/checkpoints/{g}") for g in ("normalizer", "enricher", "history")]
    tracked = files_below(f"{root}/t/history")
    whole = Topology._dead_letters

    def dies(self, group, batch_id, rows):
        if group == "novelty":
            raise RuntimeError("the executor is gone")
        whole(self, group, batch_id, rows)
    monkeypatch.setattr(Topology, "_dead_letters", dies)
    with pytest.raises(StreamingQueryException):
        topo.start("novelty").awaitTermination()
    monkeypatch.setattr(Topology, "_dead_letters", whole)
    assert [files_below(f"{root}/t/checkpoints/{g}") for g in ("normalizer", "enricher", "history")] == others
    topo.drain(("novelty", "scorer"))       # resumes with the batch it died in
    assert files_below(f"{root}/t/history") == tracked

    # the messages of batch 1 once more, under another batch id, together with the last ones
    send(2, raw[2])
    send(3, raw[1])
    topo.drain()
    monkeypatch.undo()

    assert snap(topo.history(), topo.artist_table(), topo.recommendations.read()) == \
        snap(batch.history, batch.artists, batch.recommendations)
    letters = [topo.topics.read("dead.letters", g) for g in ("history", "novelty", "scorer")]
    got = sorted((r.key, r.d) for df in letters
                 for r in df.select("key", F.get_json_object("value", "$.error_detail").alias("d")).collect())
    assert got == sorted((r.error_reason, r.error_detail) for r in batch.dlq.collect())
    assert {k for k, _ in got} == {"artist_record_missing", "validation_failed", "artist_not_found"}
    # every applied message is forwarded once, repeats of a track included
    forwarded = topo.topics.read("listening.history", "history")
    assert forwarded.count() == batch.messages.where("played").count() > batch.history.count()

    # a topic read by two groups: both have their own offsets over the same files
    done = [len([f for f in files_below(f"{root}/t/checkpoints/{g}/commits") if not f.endswith(".crc")])
            for g in ("history", "novelty")]
    assert done[0] == done[1] >= 3


def test_undecodable_events_become_dead_letters(spark):
    topo = Topology(spark, scratch("bad"), None, bindings.base_artists(spark, SF0001), buckets=4)
    spark.createDataFrame([('{"key":"a","value":"{broken"}',), ('{"key":"a","value":"{broken"}',)], "value string") \
        .write.text(topo.topics.path("tracks.novel", "import") + "/batch_id=0")
    topo.drain(("scorer",))
    (letter,) = topo.topics.read("dead.letters", "scorer").collect()     # delivered twice, one letter
    assert letter.key == "malformed_message" and "{broken" in letter.value
    assert topo.recommendations.read().count() == 0


ROWS = "k string, n bigint, tags array<string>"


def test_keyed_table_rewrites_only_the_buckets_of_its_batch(spark):
    store = SnapshotStore(spark, scratch("keyed"))
    table = KeyedTable(store, "t", "k", ROWS, buckets=64)
    assert table.read().count() == 0 and table.lookup(spark.createDataFrame([("a",)], "k string")).count() == 0
    table.upsert(0, spark.createDataFrame([(f"k{i}", i, [str(i)]) for i in range(5000)], ROWS))
    ten = spark.createDataFrame([(f"k{i}", -i, None) for i in range(0, 5000, 550)] + [("new", 1, ["x"])], ROWS)
    touched = table.upsert(1, ten)
    assert 1 <= len(touched) <= 11
    written = {d.split("=")[1] for d in os.listdir(f"{store.root}/t/data/v=1") if d.startswith("key_bucket=")}
    assert written == {str(b) for b in touched}
    want = {f"k{i}": (-i if i % 550 == 0 else i) for i in range(5000)} | {"new": 1}
    assert {r.k: r.n for r in table.read().collect()} == want
    # as of an older batch, and a batch that is replayed
    assert {r.k: r.n for r in table.read(1).collect()} == {f"k{i}": i for i in range(5000)}
    assert table.upsert(1, ten) == touched
    assert {r.k: r.n for r in table.read().collect()} == want
    assert [tuple(r) for r in table.lookup(spark.createDataFrame([("new",), ("none",)], "k string")).collect()] == [
        ("new", 1, ["x"])]


def test_keyed_table_does_not_shuffle_the_state(spark):
    store = SnapshotStore(spark, scratch("keyed"))
    table = KeyedTable(store, "t", "k", ROWS, buckets=8)
    table.upsert(0, spark.createDataFrame([(f"k{i}", i, None) for i in range(1000)], ROWS))
    rows = spark.createDataFrame([("k1", 5, None), ("k2", 6, None)], ROWS)
    keys = rows.select("k")
    for df in (table.kept(table.manifest(), rows), table.lookup(keys)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        state_side = plan.split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in state_side
    assert table.upsert(1, rows.where("false")) == [] and table.read().count() == 1000
