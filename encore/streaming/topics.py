"""Durable topics as folders of JSON lines {"key", "value"}.

A topic holds one folder per producer. Producers that are streams without
state use Spark's file sink, whose log makes readers see every committed file
exactly once; all others write one folder per batch and leave it alone once it
is complete, so a replayed batch sends nothing twice. What was sent twice all
the same (a batch that died while its files appeared, another batch with the
same messages) is left to the consumers' ledgers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from encore.streaming.state import SnapshotStore

# microseconds survive the way through JSON
JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
RECORD = "key string, value string"


def to_value(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), JSON)


def from_value(value: str | Column, schema: str | T.StructType) -> Column:
    return F.from_json(value, schema, JSON)


def records(messages: DataFrame, key: str) -> DataFrame:
    """One JSON line per message, keyed by a column."""
    value = to_value(*messages.columns)
    return messages.select(to_value(F.col(key).cast("string").alias("key"), value.alias("value")).alias("value"))


class Topics:
    """The topic folders below ``<store root>/topics``."""

    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark

    def path(self, topic: str, producer: str) -> str:
        return f"{self.store.root}/topics/{topic}/{producer}"

    def send(self, topic: str, producer: str, batch_id: int, messages: DataFrame, key: str) -> None:
        """The messages of one batch, unless its folder is complete already."""
        folder = f"topics/{topic}/{producer}"
        if not self.store.has_batch(folder, batch_id):
            records(messages, key).write.mode("overwrite").text(f"{self.store.root}/{folder}/batch_id={batch_id}")

    def sink(self, stream: DataFrame, topic: str, producer: str, key: str) -> DataStreamWriter:
        """A stream without state, through Spark's file sink."""
        return records(stream, key).writeStream.format("text").option("path", self.path(topic, producer))

    def stream(self, topic: str, producers: list[str], batched: bool, files: int | None = None) -> DataFrame:
        """(key, value) of the topic as a stream; ``batched`` producers write a
        folder per batch, the others through the file sink."""
        out = None
        for producer in producers:
            self.spark.createDataFrame([], "value string").write.mode("ignore").text(self.path(topic, producer))
            reader = self.spark.readStream
            if batched:
                reader = reader.option("recursiveFileLookup", "true")
            if files:
                reader = reader.option("maxFilesPerTrigger", files)
            lines = reader.text(self.path(topic, producer))
            out = lines if out is None else out.unionByName(lines)
        return out.select(F.from_json("value", RECORD).alias("r")).select("r.*")

    def read(self, topic: str, producer: str) -> DataFrame:
        """All records of a batched producer so far."""
        lines = self.spark.read.option("recursiveFileLookup", "true").schema("value string").text(self.path(topic, producer))
        return lines.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def parsed(stream: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Value, typed message ``m`` (null when undecodable) and
    ``message_id``: the message's seq, or a digest of what cannot be read."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*st.fields, T.StructField("_corrupt_record", T.StringType())])
    m = F.from_json("value", fields, JSON | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = stream.select("value", m.alias("m"))
    ok = F.col("m").isNotNull() & F.col("m._corrupt_record").isNull() & F.col("m.seq").isNotNull()
    plain = F.struct(*[F.col(f"m.{n}").alias(n) for n in st.names])
    return read.select("value", F.when(ok, plain).alias("m"),
                       F.when(ok, F.to_json("m.seq", JSON)).otherwise(F.sha2(F.coalesce("value", F.lit("")), 256))
                       .alias("message_id"))
