"""Statistics queries (A1-A16) and dashboard read-side operations.

Each function takes the state tables as DataFrames plus an explicit ``as_of``
(never ``current_timestamp()``), so results are reproducible. Single-row
statistics are one ``agg`` with conditional counts (one pass, partial
aggregation); day/week gap filling joins a small generated spine whose size is
fixed by the parameters (``days``/``num_weeks``), so broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.operators.joins import plays_with_artist, rec_artist
from encore.plans.lists import recommendable, status_rank
from encore.sources.bindings import STATUSES


def _ts(as_of) -> F.Column:
    return F.to_timestamp_ntz(F.lit(as_of)) if isinstance(as_of, str) else as_of


def status_summary(artists: DataFrame) -> DataFrame:
    """A1: counts of the four known statuses (case-insensitive) and their sum.
    Two spellings of one status add up; unknown statuses are left out."""
    up = F.upper(F.col("status"))
    counts = [F.count_if(up == s).cast("bigint").alias(s.lower()) for s in STATUSES]
    total = sum((F.col(s.lower()) for s in STATUSES), F.lit(0))
    return artists.agg(*counts).withColumn("total", total.cast("bigint"))


def genre_counts(artists: DataFrame, top_n: int = 10) -> DataFrame:
    """Genre frequency over artists' genre arrays. Blank genres are
    dropped but grouping uses the untrimmed value; duplicates in one artist
    count twice. Ties broken by genre."""
    g = artists.select(F.explode("genres").alias("genre"))
    return (g.filter(F.col("genre").isNotNull() & (F.trim("genre") != ""))
            .groupBy("genre").agg(F.count(F.lit(1)).alias("artist_count"))
            .orderBy(F.col("artist_count").desc(), F.col("genre")).limit(top_n))


BUCKETS = [(0, 20, False), (20, 40, False), (40, 60, False), (60, 80, False), (80, 100, True)]


def score_distribution(recs: DataFrame, artists: DataFrame) -> DataFrame:
    """A3: count/min/max/mean of score x 100 and five bucket counts, over
    non-blacklisted artists."""
    rows = rec_artist(recs, artists).filter(F.col("status") != "BLACKLISTED")
    s = F.col("score") * 100
    buckets = [F.count_if((s >= lo) & ((s <= hi) if closed else (s < hi))).alias(f"bucket_{i}")
               for i, (lo, hi, closed) in enumerate(BUCKETS)]
    return rows.agg(F.count(F.lit(1)).alias("total_scored"), F.min(s).alias("min_score"),
                    F.max(s).alias("max_score"), F.avg(s).alias("mean_score"), *buckets)


def _spine(start: F.Column, stop: F.Column, step: str, name: str, spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(start, stop, F.expr(f"INTERVAL 1 {step}"))).alias(name))


def weekly_discoveries(artists: DataFrame, as_of, num_weeks: int = 12) -> DataFrame:
    """A4: artists added per UTC ISO week (Monday start) for the last
    ``num_weeks`` weeks, zero-filled. The SQL bound (as_of - num_weeks weeks)
    reaches into an older Monday whose rows the spine then drops."""
    now = _ts(as_of)
    weekly = (artists.filter(F.col("added_at") >= now - F.make_interval(weeks=F.lit(num_weeks)))
              .groupBy(F.to_date(F.date_trunc("week", "added_at")).alias("week_start"))
              .agg(F.count(F.lit(1)).alias("new_artists")))
    monday = F.to_date(F.date_trunc("week", now))
    spine = _spine(F.date_sub(monday, 7 * (num_weeks - 1)), monday, "WEEK", "week_start", artists.sparkSession)
    return (F.broadcast(spine).join(weekly, "week_start", "left")
            .select("week_start", F.coalesce("new_artists", F.lit(0)).cast("bigint").alias("new_artists"))
            .orderBy("week_start"))


def _day_spine(now: F.Column, days: int, spark) -> DataFrame:
    return _spine(F.to_date(now - F.make_interval(days=F.lit(days - 1))), F.to_date(now), "DAY", "day", spark)


def novelty_ratio(history: DataFrame, artists: DataFrame, as_of, days: int = 30) -> DataFrame:
    """A5: per day, share of history rows whose artist (exact-name match) was
    added no earlier than 30 days before the play; 0.0 on empty days."""
    now = _ts(as_of)
    rows = plays_with_artist(history.filter(F.col("played_at") >= now - F.make_interval(days=F.lit(days))),
                             artists)
    daily = rows.groupBy(F.to_date("played_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total_plays"),
        F.count_if(F.col("artist_added_at") >= F.col("played_at") - F.make_interval(days=F.lit(30)))
        .alias("novel_plays"))
    spine = _day_spine(now, days, history.sparkSession)
    ratio = F.when(F.col("total_plays") > 0, F.col("novel_plays") / F.col("total_plays")).otherwise(0.0)
    return (F.broadcast(spine).join(daily, "day", "left")
            .select("day", F.coalesce(ratio, F.lit(0.0)).alias("ratio")).orderBy("day"))


def artist_sources(artists: DataFrame, top_n: int = 10) -> DataFrame:
    """Artists per discovery source; null and '' excluded."""
    return (artists.filter(F.col("source").isNotNull() & (F.col("source") != ""))
            .groupBy("source").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("source")).limit(top_n))


def play_velocity(history: DataFrame, as_of, days: int = 30) -> DataFrame:
    """History rows (first plays of distinct tracks) per day, zero-filled."""
    now = _ts(as_of)
    daily = (history.filter(F.col("played_at") >= now - F.make_interval(days=F.lit(days)))
             .groupBy(F.to_date("played_at").alias("day")).agg(F.count(F.lit(1)).alias("plays")))
    spine = _day_spine(now, days, history.sparkSession)
    return (F.broadcast(spine).join(daily, "day", "left")
            .select("day", F.coalesce("plays", F.lit(0)).cast("bigint").alias("plays")).orderBy("day"))


def breakdown_averages(recs: DataFrame, artists: DataFrame) -> DataFrame:
    """Mean breakdown components x 100 over non-blacklisted rows having
    both components."""
    rows = rec_artist(recs, artists).filter(
        (F.col("status") != "BLACKLISTED") & F.col("score_breakdown").isNotNull() &
        F.col("score_breakdown.genre_novelty").isNotNull() & F.col("score_breakdown.popularity_norm").isNotNull())
    return rows.agg(
        (F.avg("score_breakdown.genre_novelty") * 100).alias("avg_genre_novelty"),
        (F.avg("score_breakdown.popularity_norm") * 100).alias("avg_popularity_norm"),
        F.count(F.lit(1)).alias("total"))


def breakdown_averages_json(recs: DataFrame, artists: DataFrame) -> DataFrame:
    """A8 with ``score_breakdown`` as JSON text: key presence via
    json_object_keys, values via get_json_object (JSON ->> / ? operators)."""
    keys = F.json_object_keys("score_breakdown")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    rows = rec_artist(recs, artists).filter(
        (F.col("status") != "BLACKLISTED") & F.col("score_breakdown").isNotNull() &
        has("genre_novelty") & has("popularity_norm"))
    val = lambda k: F.get_json_object("score_breakdown", f"$.{k}").try_cast("double")
    return rows.agg((F.avg(val("genre_novelty")) * 100).alias("avg_genre_novelty"),
                    (F.avg(val("popularity_norm")) * 100).alias("avg_popularity_norm"),
                    F.count(F.lit(1)).alias("total"))


def exploration_coverage(artists: DataFrame) -> DataFrame:
    """A9 (+R8): FOLLOWING artists, how many were similar-explored, percent
    rounded to one decimal (0.0 when none), and how many are pending."""
    agg = artists.filter(F.col("status") == "FOLLOWING").agg(
        F.count(F.lit(1)).alias("total"), F.count("last_similar_explored_at").alias("explored"))
    pct = F.when(F.col("total") > 0, F.round(F.col("explored") / F.col("total") * 100, 1)).otherwise(0.0)
    return agg.select("total", "explored", pct.alias("coverage_pct"),
                      (F.col("total") - F.col("explored")).alias("pending"))


def status_funnel(artists: DataFrame) -> DataFrame:
    """Per status total and high-priority count, in lifecycle order."""
    return (artists.groupBy("status").agg(F.count(F.lit(1)).alias("total"),
                                          F.count_if(F.col("high_priority")).alias("high_priority"))
            .orderBy(status_rank("status"), F.col("status")))


def status_counts_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per status before and after a job and the positive delta."""
    b = before.groupBy("status").agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy("status").agg(F.count(F.lit(1)).alias("after"))
    j = b.join(a, "status", "full_outer").fillna(0, ["before", "after"])
    return j.withColumn("delta", F.greatest(F.col("after") - F.col("before"), F.lit(0)))


def high_priority_list(artists: DataFrame) -> DataFrame:
    """High-priority artists by scrobbles (name breaks ties)."""
    return (artists.filter(F.col("high_priority"))
            .select("name", "scrobble_count", "status")
            .orderBy(F.col("scrobble_count").desc_nulls_first(), F.col("name")))


def history_size(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("history_rows"))


def pending_backlog(history: DataFrame) -> DataFrame:
    """Rows still waiting for enrichment and their share."""
    return history.agg(F.count_if(F.col("pending_enrichment")).alias("pending"),
                       F.count(F.lit(1)).alias("total"),
                       F.coalesce(F.avg(F.col("pending_enrichment").cast("double")), F.lit(0.0)).alias("pending_rate"))


def relative_age(ts, as_of) -> F.Column:
    """"<m>m ago" under an hour, "<h>h ago" under a day, else "<d>d ago"."""
    mins = F.floor((F.unix_timestamp(_ts(as_of)) - F.unix_timestamp(ts)) / 60)
    hrs = F.floor(mins / 60)
    return (F.when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .when(hrs < 24, F.concat(hrs.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hrs / 24).cast("string"), F.lit("d ago"))))


def service_health(checkpoints: DataFrame, as_of, threshold_minutes: int = 30) -> DataFrame:
    """Per service, last play seen and whether it is stale."""
    now = _ts(as_of)
    return (checkpoints.select(
        "service", F.col("last_played_at").alias("last_seen_at"),
        ((F.unix_timestamp(now) - F.unix_timestamp("last_played_at")) > threshold_minutes * 60).alias("stale"),
        relative_age(F.col("last_played_at"), as_of).alias("age"))
        .orderBy("service"))


def source_share(artists: DataFrame) -> DataFrame:
    """Each source's rounded percentage of the counted total (top 10)."""
    top = artist_sources(artists)  # at most 10 rows: a global window over them is safe
    total = F.sum("count").over(Window.partitionBy())
    return top.select("source", "count", F.round(F.col("count") * 100 / total).cast("bigint").alias("pct"))
