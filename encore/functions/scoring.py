"""Scoring and novelty scalar functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- Fixed values: default weights of the artist score -----------------------
@dataclass(frozen=True)
class ScoreWeights:
    genre_weight: float = 0.6          # w1, multiplies the genre novelty ratio
    popularity_weight: float = 0.4     # w2, multiplies (1 - popularity / 100)
    high_priority_bonus: float = 1.2   # multiplier for high-priority artists
# ------------------------------------------------------------------------------

    def balanced(self) -> bool:
        return abs(self.genre_weight + self.popularity_weight - 1.0) <= 0.01


DEFAULT_WEIGHTS = ScoreWeights()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def genre_component(ratio, w: ScoreWeights = DEFAULT_WEIGHTS) -> Column:
    return F.lit(w.genre_weight) * _col(ratio)


def popularity_component(popularity, w: ScoreWeights = DEFAULT_WEIGHTS) -> Column:
    """w2 * (1 - coalesce(popularity, 0) / 100)."""
    pop = F.coalesce(_col(popularity).cast("double"), F.lit(0.0))
    return F.lit(w.popularity_weight) * (F.lit(1.0) - pop / F.lit(100.0))


def artist_score(ratio, popularity, high_priority, w: ScoreWeights = DEFAULT_WEIGHTS) -> Column:
    """raw = w1*ratio + w2*(1-pop/100); times the bonus when high priority; capped at 1."""
    raw = genre_component(ratio, w) + popularity_component(popularity, w)
    boosted = F.when(F.coalesce(_col(high_priority), F.lit(False)),
                     raw * F.lit(w.high_priority_bonus)).otherwise(raw)
    return F.least(boosted, F.lit(1.0))


def score_breakdown(ratio, popularity, w: ScoreWeights = DEFAULT_WEIGHTS) -> Column:
    """Components rounded to 4 decimals, as stored next to the score."""
    return F.struct(
        F.round(genre_component(ratio, w), 4).alias("genre_novelty"),
        F.round(popularity_component(popularity, w), 4).alias("popularity_norm"),
    )


def genre_novelty_ratio(new_genres, genres) -> Column:
    """size(new)/size(genres), 0.0 for an empty list; duplicates count on both sides."""
    n = F.size(_col(genres))
    return F.when(n > 0, F.size(_col(new_genres)).cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def clean_genres(genres) -> Column:
    """Drop null and empty strings only; whitespace and duplicates are kept."""
    return F.filter(F.coalesce(_col(genres), F.array().cast("array<string>")),
                    lambda g: g.isNotNull() & (g != ""))


def known_genres(genres, new_genres) -> Column:
    """Genres not in the new set, input order and duplicates kept."""
    new = _col(new_genres)
    return F.filter(_col(genres), lambda g: ~F.array_contains(new, g))


def valid_ratio(ratio) -> Column:
    """Numeric in [0, 1]; NaN and null fail."""
    r = _col(ratio)
    return r.isNotNull() & ~F.isnan(r) & (r >= 0.0) & (r <= 1.0)
