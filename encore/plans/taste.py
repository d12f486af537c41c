"""Taste vectors (X2): a listener's mean feature vector and a track's distance to it.

The mean is one aggregate per component, so it is summed before the shuffle
and only one row per listener and task travels, however many tracks a
listener has; no vectors are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_mean(vector: str, dims: int) -> Column:
    """Component-wise mean as an aggregate; missing and null components do not count."""
    return F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims)])


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null if a vector is null, of another length or without length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def taste_distance(tracks: DataFrame, listener: str, vector: str, dims: int) -> DataFrame:
    """``tracks`` with ``taste`` (the listener's mean vector) and ``distance`` to it."""
    means = tracks.groupBy(listener).agg(vector_mean(vector, dims).alias("taste"))
    return tracks.join(means, listener).withColumn("distance", cosine_distance(F.col(vector), F.col("taste")))
