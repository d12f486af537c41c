import base64
import glob
import hashlib
import os
import random
import time
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from encore.llm import warc


def rows():
    return [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nWARC-Type: x", "<p>same</p>"), (3, None, None),
            (4, "u", ""), (None, "n", "only null id"), (None, "m", "<p>same</p>"), (5, "w", "WARC/1.1\r\n\r\nPage: <urn:page:9>"),
            (6, "é Payload-Length: 1", "naïve 😀" * 5000), (7, "a", "x"), (7, "b", "x"), (8, "a", "x")]


def read(spark, least=0):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, digest string")
    headers, payloads = warc.write_archive(df, least_bytes=least)
    return headers, payloads, warc.read_archive(headers, payloads).collect()


@pytest.mark.parametrize("least", [0, 5])
def test_records_come_back(spark, least):
    headers, payloads, got = read(spark, least)
    assert len(got) == len(rows()) == headers.count()
    bodies = {(t or "").encode() for _, _, t in rows()}
    assert sorted(bytes(r.payload) for r in payloads.collect()) == sorted(bodies)     # each stored once
    last = {}
    for i, _, t in rows():
        last[t or ""] = max((x for x in (last.get(t or ""), i) if x is not None), default=None)

    def full(r):
        return tuple((x is not None, x or "") for x in r)
    want = []
    for i, u, t in rows():
        body = (t or "").encode()
        answer = len(body) < least or i == last[t or ""]
        want.append((str(i), body, base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if answer else "revisit", None if answer else str(last[t or ""])))
    assert sorted((full((str(r.page_id), bytes(r.payload), r.payload_digest, r.record_type,
                         None if r.refers_to is None else str(r.refers_to))) for r in got)) == sorted(map(full, want))
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest == (bytes(r.payload) if n else b"") + b"\r\n\r\n" and len(rest) == n + 4
        assert r.payload_bytes == len(bytes(r.payload)) and fields[b"WARC-Type"].decode() == r.record_type


def test_changed_payloads_are_found(spark):
    headers, payloads, _ = read(spark)
    changed = payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    with pytest.raises(Exception, match="a stored payload has changed"):
        warc.read_archive(headers, changed).collect()
    wrong = headers.withColumn("header", F.regexp_replace("header", "Payload-Length: 1", "Payload-Length: 2"))
    with pytest.raises(Exception, match="a header does not fit"):
        warc.read_archive(wrong, payloads).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(*warc.write_archive(df)).count() == 0


def test_urls_and_records_come_back(spark):
    urls = ["http://b/\r\nWARC-Type: x", "a\\nb", "a\\\nb", "\\", "\r", "", None, "é \\\\r"]
    df = spark.createDataFrame([(i, u, f"body {i % 3} é") for i, u in enumerate(urls)], "page_id long, url string, html string")
    records = warc.read_archive(*warc.write_archive(df))
    assert {r.page_id: r.url for r in records.collect()} == {i: u or "" for i, u in enumerate(urls)}
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, warc.read_records(records.select("record")).select(fields).collect())) == \
        sorted(map(tuple, records.select(fields).collect()))
    broken = records.withColumn("record", F.concat("record", F.lit("x").cast("binary")))
    with pytest.raises(Exception, match="does not fit its header"):
        warc.read_records(broken.select("record")).collect()


def shuffle_files(spark):
    """Paths of the shuffle files that this session has on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


def copies(spark, n=200):
    text = "".join(map(chr, random.Random(7).choices(range(0x4e00, 0x9fff), k=20000)))      # 60 KB that do not compress
    rows = spark.sparkContext.parallelize([(i, "u", text) for i in range(n)], 8)
    return spark.createDataFrame(rows, "page_id long, url string, html string"), len(text.encode())


@pytest.fixture()
def no_broadcast(spark):
    """Joins shuffle, as they do where tables are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_shuffle_stays_on_disk_once_its_table_is_written(spark, no_broadcast):
    df = spark.createDataFrame([(i, "u", f"body {i % 50}") for i in range(100)], "page_id long, url string, html string")
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    headers, payloads = warc.write_archive(df)
    end = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)         # Spark removes them in the background
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert warc.read_archive(headers, payloads).count() == 100 and payloads.count() == 50


def test_copies_are_dropped_before_the_shuffle(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(warc, "shuffles_freed", lambda spark: nullcontext(), raising=False)      # so they can be measured
    df, size = copies(spark)
    before = shuffle_files(spark)
    headers, payloads = warc.write_archive(df)
    assert sum(map(os.path.getsize, shuffle_files(spark) - before)) < 20 * size       # one a task, not one a page
    assert payloads.count() == 1
    got = warc.read_archive(headers, payloads).groupBy("record_type", "refers_to").count().collect()
    assert sorted(map(tuple, got)) == [("response", None, 1), ("revisit", 199, 199)]
