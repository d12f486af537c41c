"""Payload readers on hand-written JSON (cases the reference pins)."""


import json

from encore.sources import payloads as p


def test_single_track_page_object_is_coerced(spark):
    one = ('{"recenttracks":{"@attr":{"user":"u","page":"1","totalPages":"1"},'
           '"track":{"artist":{"#text":"A","mbid":""},"name":"T","mbid":"",'
           '"date":{"uts":"1737080400","#text":"17 Jan 2026, 02:20"}}}}')
    many = ('{"recenttracks":{"track":[{"@attr":{"nowplaying":"true"},"artist":{"#text":"A"},"name":"Now"},'
            '{"artist":{"#text":"B"},"name":"U","mbid":"m-1","date":{"uts":"0","#text":"x"}},'
            '{"artist":{"#text":"C"},"name":"NoDate"}]}}')
    pages = spark.createDataFrame([(one,), (many,)], "value string")
    tracks = p.read_play_pages(pages)
    assert tracks.count() == 4
    plays = {r.title: r for r in p.raw_plays(tracks).collect()}
    assert set(plays) == {"T", "U"}
    # the epoch wins over the display text
    assert str(plays["T"].played_at) == "2025-01-17 02:20:00"
    assert dict(plays["T"].external_ids) == {}
    assert dict(plays["U"].external_ids) == {"lastfm_mbid": "m-1"}


def test_raw_keeps_fields_outside_the_type(spark):
    page = ('{"recenttracks":{"@attr":{"totalPages":"7"},"track":[{"artist":{"#text":"B"},"name":"U",'
            '"album":{"#text":"Al"},"url":"http://x","date":{"uts":"0"}}]}}')
    row = p.read_play_pages(spark.createDataFrame([(page,)], "value string"))
    assert row.first().total_pages == 7
    raw = json.loads(p.raw_plays(row).first().raw)
    assert raw["album"] == {"#text": "Al"} and raw["url"] == "http://x"


def test_tag_payload_errors_become_empty(spark):
    df = spark.createDataFrame([('{"error": 6}',), ('{"toptags":{"tag":[{"name":"Rock","count":"12"}]}}',),
                                ("garbage",), ('{"toptags":{}}',)], "payload string")
    got = [r.t for r in df.select(p.read_tag_payload("payload").alias("t")).collect()]
    assert [len(x) for x in got] == [0, 1, 0, 0]
    assert got[1][0]["name"] == "Rock" and got[1][0]["count"] == 12


def test_similar_and_top_track_readers(spark):
    sim = spark.createDataFrame([("o", '{"similarartists":{"artist":[{"name":"X","mbid":"","match":"0.9"},'
                                       '{"name":"","mbid":"m"},{"name":"Y","mbid":"m2","match":"0.5"}]}}')],
                                "artist string, payload string")
    rows = [tuple(r) for r in p.read_similar_payload(sim).collect()]
    assert rows == [("o", 1, "X", None, 0.9), ("o", 3, "Y", "m2", 0.5)]
    top = spark.createDataFrame([("o", '{"tracks":[{"id":"t1","name":"A","artists":[]},'
                                       '{"id":"t2","name":"B","artists":[{"id":"a1","name":"P"},{"id":"a2"}]}]}')],
                                "artist string, payload string")
    rows = [(r.rank, r.title, r.track_artist_ref) for r in p.read_top_tracks(top).collect()]
    assert rows == [(2, "B", "a1")]


def test_followed_names_lowercased_distinct(spark):
    df = spark.createDataFrame([('{"artists":{"items":[{"name":"ABC"},{"name":""},{"name":"abc"}]}}',)],
                               "payload string")
    assert [r.name for r in p.read_followed(df).collect()] == ["abc"]
