"""Routing, enrichment, paging and upsert cases on hand-written rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from encore.operators.enrich import enrich
from encore.operators.ordered import artist_counters, auto_promotions, first_seen_history, upsert_artists
from encore.plans.build import empty_artists
from encore.plans.jobs import backfill_genres, explore_top_tracks, full_backfill, mark_similar_explored, schema_upgrade
from encore.plans.jobs import artist_schema_upgrade
from encore.plans.lists import _page, check_paging, list_recommendations, page_count, status_filters
from encore.plans.normalize import normalize_stage, route_history, unfold, valid_raw
from encore.plans.stages import discovery_batch, dlq_rows, route_novelty, score_events
from encore.sources import bindings
from encore.functions.text import is_valid_text

T0 = dt.datetime(2024, 1, 1)

MSG_SCHEMA = ("seq struct<i:int>, track_key string, artist string, artist_key string, title string, "
              "artist_id string, track_id string, genres array<string>, artist_popularity int, "
              "track_popularity int, source string, played boolean, played_at timestamp, "
              "enrichment_source string, pending_enrichment boolean")


def msg(i, key, artist, title, genres=None, played=True, pending=False, artist_id=None):
    return ((i,), key, artist, artist.lower() if artist else None, title, artist_id, None, genres, 50, 10,
            "lastfm", played, T0 + dt.timedelta(hours=i), "spotify", pending)


def test_valid_raw_rules(spark):
    rows = [("a", "t"), (None, "t"), ("   ", "t"), ("a", None), ("a" * 501, "t"), ("a" * 500, "t")]
    df = spark.createDataFrame(rows, "artist string, title string")
    assert valid_raw(df).count() == 2


def test_route_history(spark):
    df = spark.createDataFrame([(None, "a", "t", True), ("k", "a", "t", False), ("k", "a", "t", None),
                                ("k", None, "t", True)], "track_key string, artist string, title string, played boolean")
    assert [r.route for r in route_history(df).collect()] == ["NULL_TRACK_KEY", "skipped_not_played", "apply", "dropped"]


def test_route_novelty(spark):
    rows = [msg(1, "k1", "Known", "t"), msg(2, "", "Known", "t"), msg(3, "k3", "Known", "t", pending=True),
            msg(4, "k4", "Unknown", "t"), msg(5, "k5", "Known", "t", pending=None)]
    m = spark.createDataFrame(rows, MSG_SCHEMA)
    artists = spark.createDataFrame([("known",)], "name_key string")
    got = {r.seq.i: r.route for r in route_novelty(m, artists).collect()}
    assert got == {1: "ok", 2: "malformed_message", 3: "skipped_pending", 4: "artist_record_missing",
                   5: "malformed_message"}


def test_artist_rows_of_one_name_route_a_message_once(spark):
    m = spark.createDataFrame([msg(1, "k1", "Known", "t"), msg(2, "", "Known", "t")], MSG_SCHEMA)
    artists = spark.createDataFrame([("known",), ("known",), ("other",)], "name_key string")
    assert sorted(r.route for r in route_novelty(m, artists).collect()) == ["malformed_message", "ok"]


def test_artist_rows_of_one_name_are_promoted_by_the_same_play(spark):
    m = spark.createDataFrame([msg(i, f"k{i}", "A", "t") for i in (1, 2, 3, 4)], MSG_SCHEMA)
    artists = spark.createDataFrame([("a", "TRACKED", 0)] * 3, "name_key string, status string, scrobble_count long")
    two = m.filter(F.col("seq.i") < 3)
    assert auto_promotions(two, artists, 3).collect() == []
    third = m.filter(F.col("seq.i") == 3).first().played_at
    assert [(r.name_key, r.promoted_at) for r in auto_promotions(m, artists, 3).collect()] == [("a", third)]


def test_folded_top_tracks_are_the_same_messages(spark):
    a = artists_due(spark).filter("id in ('id1', 'id3')")
    a = a.unionByName(a).unionByName(a.filter("id = 'id1'"))
    tops = spark.createDataFrame([("a", "A", "ref", "t1", "one", 1), ("a", "A", "ref", "t2", "two", 2),
                                  ("c", "C", "ref", "t3", "three", 1)],
                                 "artist string, track_artist string, track_artist_ref string, track_ref string, "
                                 "title string, rank int")
    plain, _ = explore_top_tracks(a, tops, "2024-01-01 00:00:00")
    folded, _ = explore_top_tracks(a, tops, "2024-01-01 00:00:00", folded=True)
    assert folded.count() == 3 and plain.count() == 8
    rows = lambda df: sorted(str(r) for r in df.select(*plain.columns).collect())
    assert rows(unfold(folded)) == rows(plain)
    hits = spark.createDataFrame([], "q_artist string, q_title string, artist_uri string, track_uri string")
    normal = lambda df: rows_of(normalize_stage(df.withColumn("played_at", F.lit(None).cast("timestamp_ntz")), hits=hits))
    assert normal(unfold(folded)) == rows_of(unfold(normalize_stage(
        folded.withColumn("played_at", F.lit(None).cast("timestamp_ntz")), hits=hits)))


def test_folded_messages_are_judged_like_their_copies(spark):
    at = "struct<ts:timestamp_ntz,i:int>"
    schema = MSG_SCHEMA.replace("seq struct<i:int>", f"seq {at}").replace("timestamp,", "timestamp_ntz,")
    rows = [msg(1, "k1", "A", "t", ["rock"]), msg(2, "k2", "A", "t2", ["rock", "jazz"], played=False),
            msg(3, "k3", "B", "t", ["live", "live"], played=False), msg(4, "", "A", "t", played=False)]
    m = spark.createDataFrame([((r[-3], i),) + r[1:] for i, r in enumerate(rows)], schema)
    copies = F.when(F.col("seq.i") == 1, 3).when(F.col("seq.i") == 2, 2).when(F.col("seq.i") == 3, 2)
    folded = m.withColumn("copies", copies.cast("long"))
    artists = empty_artists(spark).unionByName(spark.createDataFrame(
        [("id-b", "B", "b", "TRACKED", False)], "id string, name string, name_key string, status string, "
        "high_priority boolean"), allowMissingColumns=True)
    one, each = discovery_batch(folded, artists), discovery_batch(unfold(folded), artists)
    for table in ("novel_events", "scored", "dlq"):
        got, want = getattr(one, table), getattr(each, table)
        assert got.count() < want.count(), table
        assert rows_of(unfold(got).select(*want.columns)) == rows_of(want), table
    for table in ("artists", "history", "recommendations"):
        assert rows_of(getattr(one, table)) == rows_of(getattr(each, table)), table


def test_backfill_lands_the_plays_of_its_pages_once(spark):
    page = json.dumps({"recenttracks": {"@attr": {"user": "u1", "page": "1", "totalPages": "1"}, "track": [
        {"artist": {"#text": "u1", "mbid": ""}, "name": "view", "mbid": "", "date": {"uts": "1704067200"}}]}})
    landed = []
    pages = spark.createDataFrame([(page,)], "value string")
    plays, marks = full_backfill(pages, None, "s", land=lambda df, name: landed.append(name) or df.checkpoint())
    assert landed == ["plays"] and plays.count() == 1
    assert marks.first().last_played_at == dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(str(r) for r in df.collect())


def test_score_routes(spark):
    rows = [("k1", "A", "uri:a", 0.5, 10), ("k2", "A", None, -0.1, 10), ("k3", "A", None, 1.1, 10),
            ("k4", "Nobody", None, 0.5, 10), ("k5", "A", None, float("nan"), 10)]
    ev = spark.createDataFrame(rows, "track_key string, artist string, artist_id string, "
                                     "genre_novelty_ratio double, artist_popularity int")
    artists = spark.createDataFrame([("id-a", "a", "uri:a", True)],
                                    "id string, name_key string, spotify_uri string, high_priority boolean")
    got = {r.track_key: r.route for r in score_events(ev, artists).collect()}
    assert got == {"k1": "ok", "k2": "validation_failed", "k3": "validation_failed",
                   "k4": "artist_not_found", "k5": "validation_failed"}


def test_history_first_delivery_and_artist_counters(spark):
    rows = [msg(1, "k1", "Band", "x", ["rock"], artist_id="spotify:artist:AAAAAAAAAA"),
            msg(2, "k1", "BAND", "x", ["pop"]),                 # repeat: scrobble +1, play +0
            msg(3, "k2", "band", "y", [], artist_id="spotify:artist:BBBBBBBBBB"),  # empty genres keep the last
            msg(4, "k3", "Band", "z", ["jazz"], played=False)]  # not played: not applied
    m = spark.createDataFrame(rows, MSG_SCHEMA)
    h = first_seen_history(m)
    hist = {r.track_key: (r.seq.i, tuple(r.genres)) for r in h.collect()}
    assert hist == {"k1": (1, ("rock",)), "k2": (3, ())}
    a = upsert_artists(empty_artists(spark), artist_counters(m, h)).collect()
    assert len(a) == 1
    r = a[0]
    assert (r.name, r.status, r.play_count, r.scrobble_count) == ("Band", "TRACKED", 2, 3)
    assert list(r.genres) == ["pop"]
    assert r.spotify_uri == "spotify:artist:BBBBBBBBBB"


ENRICH_NORMALIZED = "track_key string, artist string, title string, artist_id string, track_id string"


def test_enrichment_chain_cases(spark):
    A, T = "spotify:artist:", "spotify:track:"
    rows = [
        ("answered", "art1", "t", A + "Artist00001", T + "Track000001"),
        ("answered_empty_genres", "art2", "t", A + "Artist00002", T + "Track000002"),
        ("failed_artist_tags", "art3", "t", A + "Artist00003", T + "Track000003"),
        ("failed_track_tags", "art4", "t", A + "Artist00004", T + "Track000004"),
        ("failed_no_tags", "art5", "t", A + "Artist00005", T + "Track000005"),
        ("no_ids", "art3", "t", None, None),
        ("bad_uri", "art1", "t", T + "Artist00001", T + "Track000001"),
        ("short_uri", "art1", "t", A + "short", T + "Track000001"),
    ]
    norm = spark.createDataFrame(rows, ENRICH_NORMALIZED)
    meta = spark.createDataFrame([("Artist00001", ["indie"], 40), ("Artist00002", [], 70)],
                                 "artist_ref string, genres array<string>, popularity int")
    tmeta = spark.createDataFrame([("Track000001", 5), ("Track000002", 6)], "track_ref string, popularity int")
    tags = "array<struct<name:string,count:int>>"
    six = [("A", 50), ("B", 40), ("C", 30), ("D", 20), ("Low", 5), ("F", 99)]
    atags = spark.createDataFrame([("art2", [("Filled", 20)]), ("art3", six)], f"artist string, tags {tags}")
    ttags = spark.createDataFrame([("art4", "t", [("TrackTag", None)])], f"artist string, title string, tags {tags}")
    got = {r.track_key: r for r in enrich(norm, meta, tmeta, atags, ttags).collect()}
    assert got["answered"].enrichment_source == "spotify" and list(got["answered"].genres) == ["indie"]
    assert got["answered"].artist_popularity == 40 and got["answered"].track_popularity == 5
    # empty genres from the answer are filled from artist tags, source unchanged
    assert got["answered_empty_genres"].enrichment_source == "spotify"
    assert list(got["answered_empty_genres"].genres) == ["filled"]
    # first five tags, then the count threshold, lower-cased ("F" is sixth, "Low" too small)
    assert got["failed_artist_tags"].enrichment_source == "lastfm"
    assert list(got["failed_artist_tags"].genres) == ["a", "b", "c", "d"]
    assert got["failed_artist_tags"].artist_popularity is None
    assert list(got["failed_track_tags"].genres) == ["TrackTag"]
    assert got["failed_no_tags"].enrichment_source == "pending" and got["failed_no_tags"].pending_enrichment
    assert got["failed_no_tags"].genres is None
    # no ids: pending, but artist tags still fill the genres
    assert got["no_ids"].enrichment_source == "pending" and list(got["no_ids"].genres) == ["a", "b", "c", "d"]
    for k in ("bad_uri", "short_uri"):
        assert got[k].enrichment_source == "pending"  # invalid URI = no answer; art1 has no tags


def test_paging_limits():
    check_paging(1, 100)
    for page, size in ((1, 0), (0, 20), (-1, 20), (1, 101)):
        with pytest.raises(ValueError):
            check_paging(page, size)
    assert page_count(0, 20) == 0 and page_count(41, 20) == 3


def test_unknown_status_rejected(spark):
    with pytest.raises(ValueError):
        status_filters(spark.createDataFrame([("TRACKED",)], "status string"), status="BOGUS")


def test_schema_upgrade(spark):
    v1 = spark.createDataFrame([("k", 12, "x")], "track_key string, popularity int, audio_features string")
    v2 = schema_upgrade(v1)
    assert v2.columns == ["track_key", "artist_popularity", "track_popularity"]
    old = artist_schema_upgrade(spark.createDataFrame([("a",)], "name string"))
    assert old.first().scrobble_count == 0 and "last_similar_explored_at" in old.columns
    assert artist_schema_upgrade(old).columns == old.columns


def test_dead_letters_keep_the_whole_message(spark):
    rows = [msg(1, None, "Known", "t", ["rock"]), msg(2, "k2", "Known", None), msg(3, "k3", "Known", "t", pending=True)]
    m = spark.createDataFrame(rows, MSG_SCHEMA)
    m = m.withColumn("seq", F.struct(F.col("played_at").alias("ts"), F.col("seq.i").alias("i")))
    history = dlq_rows(route_history(m), "history", m.columns).collect()
    assert [(r.error_reason, r.error_detail) for r in history] == [("NULL_TRACK_KEY", "the track key is missing")]
    sent = json.loads(history[0].original_payload)
    assert sent["artist"] == "Known" and sent["genres"] == ["rock"] and sent["seq"]["i"] == 1
    routed = route_novelty(m, spark.createDataFrame([("known",)], "name_key string"))
    got = {json.loads(r.original_payload)["seq"]["i"]: r.error_detail for r in dlq_rows(routed, "novelty", m.columns).collect()}
    assert got == {1: "missing: track_key", 2: "missing: title"}
    # a letter can be replayed: its payload reads back as the message
    again = spark.createDataFrame([(history[0].original_payload,)], "v string").select(
        F.from_json("v", m.schema).alias("m")).select("m.*")
    assert again.first().artist_popularity == 50 and again.first().genres == ["rock"]


def test_recommendations_come_in_order(spark):
    n = 60
    recs = spark.createDataFrame([(f"id{i}", (i * 37 % 11) / 11, (0.1, 0.2), ["k1", f"k{i}"], T0) for i in range(n)],
                                 "artist_id string, score double, score_breakdown struct<genre_novelty:double,"
                                 "popularity_norm:double>, evidence_tracks array<string>, updated_at timestamp")
    artists = spark.createDataFrame([(f"id{i}", f"name{i:03d}", f"name{i:03d}", "TRACKED", False, ["g"], None)
                                     for i in range(n)], "id string, name string, name_key string, status string, "
                                    "high_priority boolean, genres array<string>, spotify_uri string")
    history = spark.createDataFrame([("k1", "A", "T")], "track_key string, artist string, title string")
    for join in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", join)
        first = list_recommendations(recs, artists, history, 1, 25).collect()
        second = list_recommendations(recs, artists, history, 2, 25).collect()
        got = [(-r.score, r.name) for r in first + second]
        assert got == sorted(got) and len(got) == 50
        assert all(r.evidence_labels[0] == "A — T" for r in first)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_later_page_has_no_offset(spark):
    rows = spark.createDataFrame([(i * 37 % 60,) for i in range(60)], "n long")
    page = _page(rows, [F.col("n").desc()], 3, 25)
    assert [r.n for r in page.collect()] == list(range(9, -1, -1)) and page.columns == ["n"]
    assert "offset" not in page._jdf.queryExecution().toString().lower()


def artists_due(spark):
    rows = [("id1", "a", "FOLLOWING", "spotify:artist:x", 5), ("id2", "b", "FOLLOWING", None, 9),
            ("id3", "c", "FOLLOWING", "spotify:artist:z", 1), ("id4", "d", "TRACKED", "spotify:artist:w", 7),
            ("id5", "e", "PUBLISHED", None, 99), ("id6", "f", "FOLLOWING", "spotify:artist:v", 0)]
    df = spark.createDataFrame(rows, "id string, name string, status string, spotify_uri string, play_count long")
    return df.select("*", F.col("name").alias("name_key"), F.lit(None).cast("timestamp_ntz").alias("last_explored_at"),
                     F.lit(None).cast("timestamp_ntz").alias("last_similar_explored_at"),
                     F.lit(None).cast("array<string>").alias("genres"))


def test_only_answered_artists_are_marked(spark):
    a = artists_due(spark)
    tops = spark.createDataFrame([("a", "A", "ref", "t", "title", 1)],
                                 "artist string, track_artist string, track_artist_ref string, track_ref string, "
                                 "title string, rank int")
    answered = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "artist string")
    _, after = explore_top_tracks(a, tops, "2024-01-01 00:00:00", answered=answered)
    # b has no id, d is not followed, f got no answer, c an empty one
    assert {r.id for r in after.filter("last_explored_at is not null").collect()} == {"id1", "id3"}
    after = mark_similar_explored(a, answered, "2024-01-01 00:00:00")
    assert {r.id for r in after.filter("last_similar_explored_at is not null").collect()} == {"id1", "id2", "id3"}
    assert dict(after.dtypes)["last_similar_explored_at"] == "timestamp_ntz"


def test_backfill_order(spark):
    tags = spark.createDataFrame([("a", [("Rock", 20)])], "artist string, tags array<struct<name:string,count:int>>")
    got = [r.name for r in backfill_genres(artists_due(spark), tags).collect()]
    assert got == ["b", "a", "c", "f", "d", "e"]


def test_blank_is_unicode_blank(spark):
    rows = [("\t\n",), ("\u00a0",), ("\u3000 ",), ("a\u00a0",), (None,)]
    got = [r.ok for r in spark.createDataFrame(rows, "v string").select(is_valid_text("v").alias("ok")).collect()]
    assert got == [False, False, False, True, False]


def test_events_run_to_recommendations(spark):
    from conftest import SF0001
    res = discovery_batch(bindings.event_plays(spark, SF0001), empty_artists(spark))
    assert res.recommendations.count() > 0 and res.novel_events.count() > 0
    assert res.artists.filter("status = 'FOLLOWING'").count() > 0
