"""Corpus cleaning pipeline over the operators of `encore.llm`.

Each stage gets the documents that its predecessor kept and returns the
documents it keeps (the last one: their token counts and digests). `run`
writes every stage's result as Parquet into the shared checkpoint folder and
rereads it, so a lost executor never costs more than the current stage.

Rows with the same doc_id are one document from stage three on. All other
edge cases (nulls, empty texts, empty tables, further columns) are those of
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.llm import attention_mil, bpe, line_dedup, simhash, winnowing
from encore.llm.common import crc_mod, land, table

KEEP_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at KEEP_QUALITY or more."""
    labels = table(spark, sf_dir, "labels")
    par = attention_mil.fit(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    # the row travels as one column: none of its names clashes with the operator's
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    scored = attention_mil.score(whole, par, carry=["row"])
    return scored.where(F.col("score") >= KEEP_QUALITY).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which no word is left go."""
    # the row travels as one column: its names clash with none of the operator's
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    found = line_dedup.dedup_lines(whole)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.where(F.col("text").isNull() | left).select(
        *[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id; rows without an id stay."""
    found = simhash.near_duplicates(docs)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    # of rows with one doc_id the one of the least hash stays, whatever the plan
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    least = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                        F.row_number().over(order).alias("nth"))
    return least.where("nth = 1").select("row.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    import public_tokenizers
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The learned stage cannot be written as SQL; tests check the stages against brute force.
ORACLE_SQL = None
