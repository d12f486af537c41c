"""Files of several schema versions read as one table."""

import pytest
from pyspark.errors import PySparkException

from encore.sources.versions import HISTORY_VERSIONS, Version, merged_columns, read_versions, write_version

V1 = Version(1, {"k": "string", "popularity": "int", "features": "string"})
V2 = Version(2, {"k": "string", "artist_popularity": "int", "n": "bigint"},
             renamed={"artist_popularity": "popularity"}, added={"n": "0"})
V3 = Version(3, {"k": "string", "score": "int", "n": "bigint", "tags": "array<string>"},
             renamed={"score": "artist_popularity"}, added={"tags": "array('old')"})


def test_renames_defaults_and_drops_over_three_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(spark.createDataFrame([("a", 1, "x"), ("b", None, None)], "k string, popularity int, features string"), path, V1)
    write_version(spark.createDataFrame([("c", 3, 7), ("d", None, None)], "k string, artist_popularity int, n long"), path, V2)
    write_version(spark.createDataFrame([("e", 5, 9, ["t"]), ("f", None, None, None)],
                                        "k string, score int, n long, tags array<string>"), path, V3)
    got = read_versions(spark, path, (V1, V2, V3))
    assert got.columns == ["k", "score", "n", "tags", "schema_version"]
    # a null that a version wrote stays null; only columns that it did not have get the default
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", 1, 0, ["old"], 1), ("b", None, 0, ["old"], 1), ("c", 3, 7, ["old"], 2), ("d", None, None, ["old"], 2),
        ("e", 5, 9, ["t"], 3), ("f", None, None, None, 3)]
    plan = got.where("schema_version = 2")._jdf.queryExecution().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(schema_version" in plan
    write_version(spark.createDataFrame([("g", 1, 1)], "k string, artist_popularity int, n long"), path, V2, "append")
    assert got.sparkSession.read.parquet(f"{path}/schema_version=2").count() == 3


def test_unknown_versions_and_contradictions_fail(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(spark.createDataFrame([("a", 1, "x")], "k string, popularity int, features string"), path, V1)
    write_version(spark.createDataFrame([("c", 3, 7)], "k string, artist_popularity int, n long"), path, V2)
    with pytest.raises(PySparkException, match="unknown schema version 2"):
        read_versions(spark, path, (V1,)).collect()
    with pytest.raises(ValueError, match="popularity is int"):
        merged_columns((V1, Version(2, {"k": "string", "popularity": "string"})))
    with pytest.raises(ValueError, match="no later version adds"):
        read_versions(spark, path, (V1, Version(2, {"k": "string", "n": "bigint"})))


def test_empty_table_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(spark.createDataFrame([], "k string, popularity int, features string"), path, V1)
    got = read_versions(spark, path, (V1, V2, V3))
    assert got.count() == 0 and got.schema["tags"].dataType.simpleString() == "array<string>"
    assert list(merged_columns(HISTORY_VERSIONS))[-1] == "sources"
