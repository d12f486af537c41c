"""Readers for the landed parquet tables.

Only ``spark.read.parquet`` with the columns a caller selects afterwards:
Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """S9 over a relational store (the reference keeps its four tables in
    PostgreSQL). With a numeric ``partition_column`` and bounds the read is
    split into ``num_partitions`` parallel range queries; otherwise it is a
    single task. Needs the JDBC driver jar on the cluster (not available in
    the local test image, so this path is untested here)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    return reader.load()
