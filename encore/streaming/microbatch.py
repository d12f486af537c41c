"""Structured Streaming wiring: the batch stages inside ``foreachBatch``.

Each micro-batch reads the newest state snapshot older than its batch id,
runs ``discovery_batch`` (history -> artists -> novelty -> scores) and writes
the new snapshots under its own batch id. A replayed batch id therefore
recomputes and overwrites the same version: effects are exactly-once even
though delivery is at-least-once. Messages must carry ``seq``; a later batch
must hold later ``seq`` values (the source offset order), as in the
reference's per-partition arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.plans.stages import discovery_batch
from encore.streaming.state import SnapshotStore

STATE_TABLES = ("history", "artists", "recommendations", "first2_artist", "first2_genre")


APPEND_TABLES = ("history",)

# topic -> (table of the batch, record key)
TOPICS = {"listening.history": ("history", "track_key"), "tracks.novel": ("novel_events", "track_key"),
          "dead.letters": ("dlq", "error_reason")}


def process_batch(store: SnapshotStore, batch: DataFrame, batch_id: int, base_artists: DataFrame) -> dict:
    """Apply one micro-batch; returns what it wrote by table name. History is
    append-only (this batch's inserted rows); the other tables are versioned
    snapshots, the first-two tables holding at most two rows per key."""
    history = store.read_appended_before("history", batch_id)
    artists = store.read_before("artists", batch_id)
    recs = store.read_before("recommendations", batch_id)
    f2a = store.read_before("first2_artist", batch_id)
    f2g = store.read_before("first2_genre", batch_id)
    if artists is None:
        artists = base_artists
    written: dict = {}

    def land(name: str, df: DataFrame) -> DataFrame:
        if name in APPEND_TABLES:
            written[name] = store.append(name, batch_id, df)
        else:
            written[name] = store.write(name, batch_id, df)
        return written[name]

    first2 = (f2a, f2g) if f2a is not None and f2g is not None else None
    res = discovery_batch(batch, artists, history, recs, land=land, first2_state=first2)
    written["history_all"] = res.history
    for topic, (name, key) in TOPICS.items():
        write_topic(written[name], key, f"{store.root}/topics/{topic}/batch_id={batch_id}")
    return written


def start(spark: SparkSession, source: DataFrame, store: SnapshotStore, base_artists: DataFrame,
          checkpoint_location: str, trigger: dict | None = None):
    """Run the pipeline as a streaming query over ``source`` (any streaming
    DataFrame with the enriched message schema)."""
    def run(batch_df: DataFrame, batch_id: int) -> None:
        if batch_df.isEmpty():
            return
        process_batch(store, batch_df, batch_id, base_artists)

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def parse_topic(raw: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """JSON topic values -> typed rows; undecodable values go to a
    DLQ frame (``malformed_message``) instead of failing the batch."""
    from pyspark.sql import types as T
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_corrupt = T.StructType(list(st.fields) + [T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.select(F.col("value").cast("string").alias("value"),
                        F.from_json(F.col("value").cast("string"), with_corrupt,
                                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
                        .alias("m"))
    broken = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()
    ok = parsed.filter(~broken).select("m.*").drop("_corrupt_record")
    bad = parsed.filter(broken).select(
        F.lit("malformed_message").alias("error_reason"),
        F.col("value").alias("original_payload"))
    return ok, bad


def topic_stream(spark: SparkSession, bootstrap_servers: str, topics: str, schema,
                 starting_offsets: str = "earliest") -> tuple[DataFrame, DataFrame]:
    """S5 over Kafka: one stream for several comma-separated topics (D5),
    parsed with ``parse_topic``. Needs the spark-sql-kafka package on the
    cluster; local tests use the file source instead."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", bootstrap_servers)
           .option("subscribe", topics)
           .option("startingOffsets", starting_offsets)
           .load())
    return parse_topic(raw, schema)


def write_topic(df: DataFrame, key_col: str, path: str) -> None:
    """S6 as a file sink: a batch's keyed JSON records, one line each. A
    replayed batch overwrites its own folder."""
    topic_sink_frame(df, key_col).select(F.to_json(F.struct("key", "value")).alias("value")) \
        .write.mode("overwrite").text(path)


def read_topic(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """The records (key, value) a sink has written for ``topic``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{root}/topics/{topic}")
    return lines.select(F.from_json("value", "key string, value string").alias("r")).select("r.*")


def topic_sink_frame(df: DataFrame, key_col: str) -> DataFrame:
    """Keyed JSON records (the shape a Kafka sink expects)."""
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
