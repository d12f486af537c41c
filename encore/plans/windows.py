"""Event-time windows over plays (X1), for landed logs and streams alike.

Windows are half-open and start on the hour, at midnight and on Monday, all in
UTC. On a stream a watermark bounds the open windows: a play whose window has
closed (its end lies at or before the greatest ``played_at`` seen, less
``late``) is left out, and no other. A batch sees all plays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# period -> window length, offset of its start from the epoch (a Thursday)
PERIODS = {"hour": ("1 hour", "0 hours"), "day": ("1 day", "0 days"), "week": ("7 days", "4 days")}


def plays_per_period(plays: DataFrame, period: str, late: str | None = None) -> DataFrame:
    """period, start, plays. ``late`` (an interval) sets the watermark of a stream."""
    length, offset = PERIODS[period]
    rows = plays.where("played_at is not null")
    if late:
        rows = rows.withColumn("played_at", F.col("played_at").cast("timestamp")).withWatermark("played_at", late)
    at = F.window("played_at", length, startTime=offset)
    return rows.groupBy(at.alias("w")).agg(F.count(F.lit(1)).alias("plays")).select(
        F.lit(period).alias("period"), F.col("w.start").cast("timestamp_ntz").alias("start"), "plays")


def novel_ratio_per_period(judged: DataFrame, novel: DataFrame, period: str) -> DataFrame:
    """start, messages, novel, ratio by arrival (``seq.ts``) of the judged messages."""
    length, offset = PERIODS[period]
    rows = judged.select("seq.ts", F.lit(0).alias("n")).unionByName(novel.select("seq.ts", F.lit(1).alias("n")))
    each = rows.groupBy(F.window("ts", length, startTime=offset).alias("w")).agg(
        F.count_if(F.col("n") == 0).alias("messages"), F.count_if(F.col("n") == 1).alias("novel"))
    return each.select(F.col("w.start").alias("start"), "messages", "novel",
                       F.try_divide("novel", "messages").alias("ratio"))


def new_genres_per_month(history: DataFrame) -> DataFrame:
    """month, new_genres: genres by the month in which a first play brought them."""
    first = (history.select(F.explode("genres").alias("genre"), "played_at").where("genre <> ''")
             .groupBy("genre").agg(F.min("played_at").alias("at")))
    return first.groupBy(F.trunc("at", "month").alias("month")).agg(F.count(F.lit(1)).alias("new_genres"))
