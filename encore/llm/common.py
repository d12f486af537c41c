"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.session import ensure_checkpoint_dir, shuffles_freed  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SMALL_BATCH = 4 << 20        # bytes of an Arrow batch where a task runs beside others for long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, batch_bytes: int = 16 << 20) -> None:
    """Bound the Arrow batches sent to Python tasks by bytes, so a run of very
    long texts cannot make one batch of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    ensure_checkpoint_dir(spark)


def land(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and reread it.

    Cuts the lineage: a lost executor costs only the tasks that read the
    table again. `options` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/encore-llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
