import os

import pytest

import corpus_pipeline
from encore.llm import queries, simhash
from tests.llm.conftest import edge_rows, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, tmp_path, edge_docs, labels):
    more = [(i, prose(i, 60), "en", "s", 0) for i in range(100, 130)]
    more.append((200, prose(500, 20) + " " + prose(77, 12) + " " + prose(501, 20), "en", "s", 0))
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars").union(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 12))], "item_id long, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables).cache()
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)
    assert {1, 100, 129, 200} <= kept["line_dedup"] and 2 not in kept["line_dedup"]
    assert 200 in kept["near_dedup"] and 200 not in kept["decontamination"]
    assert kept["byte_bpe"] == kept["decontamination"] >= {1, 100, 129}


def test_one_of_each_group_stays(spark):
    rows = [(i, t, "en", "s", 0) for i, t in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}
    stay = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in stay if x is not None) == sorted(groups) and stay.count(None) == 2


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_oracle_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        mine = queries.QUERIES[name](spark, SF)
        theirs = con.execute(sql)
        columns = [d[0] for d in theirs.description]
        assert sorted(columns) == sorted(mine.columns)
        assert sorted(map(str, map(tuple, mine.select(columns).collect()))) == sorted(map(str, theirs.fetchall())), name


def test_names_that_clash_and_missing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr(
        "doc_id", "text", "1 as score", "2 as n_removed", "3 as n_lines", "4 as fp", "5 as row", "6 as component_id",
        "7 as nth", "8 as n_hit", "9 as top_passage", "10 as kept")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        if name != "byte_bpe":
            assert docs.columns == columns
            assert docs.selectExpr("sum(score) = count(*)", "sum(nth) = 7 * count(*)").first() == (True, True)
    assert docs.count() > 0


def test_rows_of_one_id_are_chosen_alike_whatever_the_plan(spark):
    rows = [(7, f"text number {i} " + prose(1, 60), "en", f"s{i}", i) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {corpus_pipeline.near_dedup(spark, frame.repartition(n), "").first().source for n in (1, 3, 5)}
    assert len(got) == 1
