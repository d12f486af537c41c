"""Keyed state tables of which a batch rewrites only the buckets it changes.

A table is dealt into key buckets. Each batch writes the buckets that hold a
changed key below its own id, then a manifest (bucket -> batch that wrote it)
whose completion is the commit. A batch reads the newest manifest below its
own id, and of it only the buckets of its own keys; so a replayed batch sees
the same state and overwrites its own version, and a reader is never
disturbed by a writer. The files are written and read by Spark; this class
only keeps track of which belong together.

Batches are small beside the state: while their keys number at most
BROADCAST_ROWS they are broadcast, and no row of the state is shuffled;
beyond that Spark chooses the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.streaming.state import SnapshotStore

BUCKETS = 64
BROADCAST_ROWS = 100_000
LATEST = (1 << 62)
BUCKET = "key_bucket"


class KeyedTable:
    """Rows of unique ``key`` with ``schema``, in a folder of ``store``."""

    def __init__(self, store: SnapshotStore, name: str, key: str, schema: T.StructType | str, buckets: int = BUCKETS):
        self.store, self.spark, self.name, self.key, self.buckets = store, store.spark, name, key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.root = f"{store.root}/{name}"

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int = LATEST) -> dict[int, int]:
        """bucket -> the batch whose version of it is current below ``before``."""
        at = self.store.read_before(f"{self.name}/manifest", before)
        return {} if at is None else {r["bucket"]: r["version"] for r in at.collect()}

    def read(self, before: int = LATEST, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of ``before``, of all or some buckets."""
        now = self.manifest(before)
        if buckets is not None:
            now = {b: now[b] for b in buckets if b in now}
        if not now:
            return self.spark.createDataFrame([], self.schema)
        return self._read(now).select(*self.schema.names)

    def _read(self, versions: dict[int, int]) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("v", T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        paths = [f"{self.root}/data/v={v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of ``keys``; at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def lookup(self, keys: DataFrame, before: int = LATEST) -> DataFrame:
        """The rows of ``keys`` (a landed frame with the key column) as of
        ``before``; reads only their buckets."""
        keys = keys.select(self.key).distinct()
        old = self.read(before, self.touched(keys))
        return old.join(self._small(keys), self.key, "left_semi")

    def _small(self, keys: DataFrame) -> DataFrame:
        few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return F.broadcast(keys) if few else keys

    def upsert(self, batch_id: int, rows: DataFrame) -> list[int]:
        """Insert ``rows`` or replace those of their keys, as batch
        ``batch_id``. Returns the buckets that were rewritten."""
        rows = self.store.write(f"{self.name}/changes", batch_id,
                                rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()))
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        now = self.manifest(batch_id)
        if touched:
            old = {b: now[b] for b in touched if b in now}
            merged = rows
            if old:
                merged = self.kept(old, rows).unionByName(rows)
            merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/data/v={batch_id}")
        now |= {b: batch_id for b in touched}
        listed = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
        self.store.write(f"{self.name}/manifest", batch_id, listed)
        return touched

    def kept(self, versions: dict[int, int], rows: DataFrame) -> DataFrame:
        """The rows of these buckets whose keys ``rows`` does not replace."""
        return self._read(versions).drop("v").join(self._small(rows.select(self.key)), self.key, "left_anti")
