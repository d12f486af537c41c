"""Vector rows for the operators that meet a stated set of rows with all rows.

Both sides are dealt into blocks of bounded size, every block of one side
travels to every block of the other in one shuffle, and a task streams its
pairs of blocks: the rows of kind 0 are held (their number is bounded by the
block), those of kind 1 pass by in batches. Only vectors of equal length meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_vector(vector: Column) -> Column:
    """The vector is not null and neither are its components; all are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def blocks_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def block_no(id_col: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def every_block(blocks: int) -> Column:
    """One row for each block of the other side."""
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def meet(held: DataFrame, passing: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Both sides dealt by `keys`; in a task the held rows of a key come before those that pass it.

    Both have the columns `keys`, id, vector and further ones; `kind` is added.
    """
    both = held.withColumn("kind", F.lit(0)).unionByName(passing.withColumn("kind", F.lit(1)),
                                                        allowMissingColumns=True)
    return both.repartition(partitions, *keys).sortWithinPartitions(*keys, "kind", "id", "label", "vector")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of equal length in `column` as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(key, kind, rows) of the consecutive rows with one key and kind; a run ends with its batch.

    Of rows with the same id in a run only the first (least by label, then
    vector) is passed on, also across batches.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "kind", "id"]]).astype(np.int64)
        here = np.ones(batch.num_rows, bool)
        here[1:] = (marks[:, 1:] != marks[:, :-1]).any(axis=0)
        here[0] = last is None or (marks[:, 0] != last).any()
        last = marks[:, -1].copy()
        batch, marks = batch.filter(pa.array(here)), marks[:-1, here]
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield tuple(marks[:-1, a].tolist()), int(marks[-1, a]), batch.slice(a, b - a)
