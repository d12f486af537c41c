"""List endpoints (O1-O8) and their paging arithmetic (O3)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.operators.joins import artist_origin, evidence_labels, rec_artist
from encore.sources.bindings import STATUSES

MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 20


def check_paging(page: int, page_size: int) -> None:
    """O3 argument limits: page >= 1, 1 <= page_size <= 100."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")


def page_count(total: int, page_size: int) -> int:
    """O3: ceil(total / page_size), 0 when empty."""
    return math.ceil(total / page_size) if total > 0 else 0


def _page(df: DataFrame, order, page: int, page_size: int) -> DataFrame:
    check_paging(page, page_size)
    rows = df.orderBy(*order).limit(page * page_size)
    if page == 1:
        return rows
    # numbered, not `offset`: over one, adaptive re-planning now and then dropped the sort of the page
    nth = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") > (page - 1) * page_size).drop("_nth")


def status_filters(artists: DataFrame, status: str | None = None,
                   high_priority: bool | None = None) -> DataFrame:
    """P10: optional status / high_priority conjunction."""
    if status is not None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        artists = artists.filter(F.col("status") == status)
    if high_priority is not None:
        artists = artists.filter(F.col("high_priority") == F.lit(high_priority))
    return artists


def list_artists(artists: DataFrame, status: str | None = None, high_priority: bool | None = None,
                 page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """O1: by scrobble_count DESC with NULLs first (the reference's database
    order), name key as the tie-breaker."""
    rows = artist_origin(status_filters(artists, status, high_priority), artists)
    return _page(rows, [F.col("scrobble_count").desc_nulls_first(), F.col("name_key").asc()], page, page_size)


def recommendable(df: DataFrame, include_following: bool = False) -> DataFrame:
    """Never BLACKLISTED; FOLLOWING only on request."""
    excluded = ["BLACKLISTED"] if include_following else ["BLACKLISTED", "FOLLOWING"]
    return df.filter(~F.col("status").isin(*excluded))


def list_recommendations(recs: DataFrame, artists: DataFrame, history: DataFrame,
                         page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
                         include_following: bool = False) -> DataFrame:
    """O2: recommendations JOIN artists, by score DESC then name ASC, with
    evidence keys mapped to readable labels."""
    rows = recommendable(rec_artist(recs, artists), include_following)
    order = [F.col("score").desc(), F.col("name").asc()]
    # labelling joins and regroups, so the page (at most 100 rows) is put in order again after it
    return evidence_labels(_page(rows, order, page, page_size), history).repartition(1).sortWithinPartitions(*order)


def recommendation_total(recs: DataFrame, artists: DataFrame, include_following: bool = False) -> DataFrame:
    """COUNT(*) under the same filter as the list."""
    return recommendable(rec_artist(recs, artists), include_following).agg(F.count(F.lit(1)).alias("total"))


def status_rank(col="status"):
    """TRACKED, FOLLOWING, PUBLISHED, BLACKLISTED, then anything else."""
    c = F.col(col)
    expr = F.when(c == STATUSES[0], 1)
    for i, s in enumerate(STATUSES[1:], start=2):
        expr = expr.when(c == s, i)
    return expr.otherwise(len(STATUSES) + 1)


def recent_plays(history: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` history rows by played_at (track key breaks ties)."""
    return history.orderBy(F.col("played_at").desc(), F.col("track_key").desc()).limit(n)


def exploration_queue(artists: DataFrame, ts_col: str, older_than) -> DataFrame:
    """P14/P15 + O6: FOLLOWING artists never explored or explored before
    ``older_than``, never-explored first."""
    c = F.col(ts_col)
    return (artists.filter((F.col("status") == "FOLLOWING") & (c.isNull() | (c < older_than)))
            .orderBy(c.asc_nulls_first(), F.col("name_key")))
