"""De-duplication operators.

D3 ``similar_dedup`` is not a plain dedup: candidates are processed in order;
one is skipped when its mbid is already known, rejected when its case-folded
name is taken, else inserted -- and inserted candidates block later ones
while rejected ones block nothing. It is solved in rounds: every round
accepts the candidates that come first among the remaining ones for both of
their keys, then drops the remaining rows sharing a key with an accepted one.
Each round is a pair of aggregations and joins (no pairwise comparison); the
loop ends when nothing remains, and lineage is cut with ``checkpoint()``
every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _min_ord(df: DataFrame, key: str, alias: str) -> DataFrame:
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min("ord").alias(alias)))


def similar_dedup(candidates: DataFrame, artists: DataFrame) -> DataFrame:
    """``candidates``: ord (orderable, unique), name, mbid (nullable) + payload.
    ``artists``: name_key, lastfm_mbid. Returns every candidate with
    ``outcome`` in {inserted, skipped, conflict}."""
    cand = candidates.withColumn("name_key", F.lower("name"))
    known_mbid = artists.filter(F.col("lastfm_mbid").isNotNull()).select(
        F.col("lastfm_mbid").alias("mbid")).distinct().withColumn("_km", F.lit(True))
    known_name = artists.select("name_key").distinct().withColumn("_kn", F.lit(True))
    marked = (cand.join(known_mbid, "mbid", "left").join(known_name, "name_key", "left"))
    pre_skipped = marked.filter(F.col("_km").isNotNull()).drop("_km", "_kn").withColumn("outcome", F.lit("skipped"))
    pre_conflict = marked.filter(F.col("_km").isNull() & F.col("_kn").isNotNull()).drop("_km", "_kn")
    remaining = marked.filter(F.col("_km").isNull() & F.col("_kn").isNull()).drop("_km", "_kn")

    accepted_parts = []
    while True:
        # one job per round: every row that is left, with whether it is accepted now
        by_name = _min_ord(remaining, "name_key", "_fn")
        by_mbid = _min_ord(remaining, "mbid", "_fm")
        first = (F.col("ord") == F.col("_fn")) & (F.col("mbid").isNull() | (F.col("ord") == F.col("_fm")))
        judged = (remaining.join(by_name, "name_key", "left").join(by_mbid, "mbid", "left")
                  .withColumn("_acc", F.coalesce(first, F.lit(False))).drop("_fn", "_fm").checkpoint())
        if judged.isEmpty():
            break                     # every round accepts the first remaining candidate at least
        acc = judged.filter("_acc").drop("_acc")
        accepted_parts.append(acc)
        taken_names = acc.select("name_key").distinct().withColumn("_tn", F.lit(True))
        taken_mbids = acc.filter(F.col("mbid").isNotNull()).select("mbid").distinct().withColumn("_tm", F.lit(True))
        remaining = (judged.filter(~F.col("_acc")).drop("_acc")
                     .join(taken_names, "name_key", "left").join(taken_mbids, "mbid", "left")
                     .filter(F.col("_tn").isNull() & F.col("_tm").isNull()).drop("_tn", "_tm"))

    accepted = (accepted_parts[0] if accepted_parts else
                marked.filter(F.lit(False)).drop("_km", "_kn"))
    for part in accepted_parts[1:]:
        accepted = accepted.unionByName(part)
    accepted = accepted.withColumn("outcome", F.lit("inserted"))
    # every other row: skipped if an earlier inserted row holds its mbid (the
    # mbid check comes first), else a name conflict
    in_rounds = (marked.filter(F.col("_km").isNull() & F.col("_kn").isNull()).drop("_km", "_kn")
                 .join(accepted.select("ord"), "ord", "left_anti")).unionByName(pre_conflict)
    acc_mbid = _min_ord(accepted, "mbid", "_am")
    rejected = (in_rounds.join(acc_mbid, "mbid", "left")
                .withColumn("outcome", F.when(F.col("_am") < F.col("ord"), F.lit("skipped"))
                            .otherwise(F.lit("conflict"))).drop("_am"))
    return pre_skipped.unionByName(accepted).unionByName(rejected)


def topic_union(*frames: DataFrame) -> DataFrame:
    """One consumer reading several topics = union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
