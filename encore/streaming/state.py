"""Replay-safe state: versioned snapshots and ingestion high-water marks.

State tables are parquet snapshots ``<root>/<table>/v=<batch_id>``; a batch
reads the newest version below its own id and writes its own id, so a
replayed batch recomputes the same version from the same input (exactly-once
by idempotent overwrite). The root must be a shared folder (by default under
the cluster's ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_COLUMNS = ["service", "last_played_at", "updated_at"]


def advance_checkpoint(state: DataFrame | None, rows: DataFrame, service: str) -> DataFrame:
    """New high-water mark = max(played_at) of what was pulled, written
    only when something was pulled; last write per service wins."""
    upd = (rows.agg(F.max("played_at").alias("last_played_at"))
           .filter(F.col("last_played_at").isNotNull())
           .select(F.lit(service).alias("service"), "last_played_at",
                   F.col("last_played_at").alias("updated_at")))
    if state is None:
        return upd
    merged = state.select(*CHECKPOINT_COLUMNS).unionByName(upd)
    return (merged.groupBy("service")
            .agg(F.max_by(F.struct("last_played_at", "updated_at"), F.col("updated_at")).alias("c"))
            .select("service", "c.last_played_at", "c.updated_at"))


def high_water_mark(checkpoints: DataFrame, service: str) -> F.Column:
    """The service's mark as a scalar subquery (one value, computed once;
    null when the service has no checkpoint yet)."""
    return checkpoints.filter(F.col("service") == service).select(F.max("last_played_at")).scalar()


def pull_since(rows: DataFrame, checkpoints: DataFrame, service: str) -> DataFrame:
    """S3: rows at or after the service's high-water mark (all when none)."""
    hwm = high_water_mark(checkpoints, service)
    return rows.filter(hwm.isNull() | (F.col("played_at") >= hwm))


class SnapshotStore:
    """Versioned parquet snapshots of named state tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, path: str) -> bool:
        at, fs = self._folder(f"{path}/_SUCCESS")
        return fs.exists(at)

    def _names(self, table: str, prefix: str) -> list[int]:
        """The numbers of the folders ``<prefix><number>`` of a table."""
        at, fs = self._folder(table)
        if not fs.exists(at):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(at)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))

    def _versions(self, table: str) -> list[int]:
        return [v for v in self._names(table, "v=") if self._complete(f"{table}/v={v}")]

    def read_before(self, table: str, batch_id: int) -> DataFrame | None:
        """Newest committed version strictly older than ``batch_id``."""
        for v in sorted((v for v in self._names(table, "v=") if v < batch_id), reverse=True):
            if self._complete(f"{table}/v={v}"):
                return self.spark.read.parquet(f"{self.root}/{table}/v={v}")
        return None

    def has_batch(self, table: str, batch_id: int) -> bool:
        """Whether the rows that batch ``batch_id`` appended are complete."""
        return self._complete(f"{table}/batch_id={batch_id}")

    def write(self, table: str, batch_id: int, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{table}/v={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def append(self, table: str, batch_id: int, df: DataFrame) -> DataFrame:
        """Write this batch's rows as partition ``batch_id`` of an append-only
        table (a replay overwrites the same partition)."""
        path = f"{self.root}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def read_appended_before(self, table: str, batch_id: int) -> DataFrame | None:
        """All rows appended by batches older than ``batch_id`` (partition
        pruning on batch_id)."""
        done = [v for v in self.appended(table) if v < batch_id]
        if not done:
            return None
        df = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(
            *[f"{self.root}/{table}/batch_id={v}" for v in done])
        return df.drop("batch_id")

    def appended(self, table: str) -> list[int]:
        """Ids of the batches whose rows of ``table`` are complete."""
        return [b for b in self._names(table, "batch_id=") if self._complete(f"{table}/batch_id={b}")]

    def latest(self, table: str) -> DataFrame | None:
        vs = self._versions(table)
        return self.spark.read.parquet(f"{self.root}/{table}/v={vs[-1]}") if vs else None


def default_root(spark: SparkSession, name: str) -> str:
    from encore.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "encore-streams", name)
