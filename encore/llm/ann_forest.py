"""Approximate nearest neighbours by a forest of random-projection trees.

Rows are dealt into shards of at most about `shard_rows` rows, and every
shard holds a forest over its own rows: a node projects its rows onto the
difference of two of them and halves them at the median, down to leaves. All
rows are indexed. Every query visits every shard: the leaves of all trees
stand in one queue, ordered by how far the query lies beyond the worst split
on the way to the leaf (the order in which a best-first search over all trees
at once opens them), and are opened until rows amounting to `budget` of the
shard, and `least_met`, were met. The rows of the opened leaves are the candidates; they are ranked by
their exact cosine. The shards' best are merged in one top-k shuffle.

One shuffle deals rows and queries; a task holds one shard and streams the
queries past it. Queries are dealt into groups, so neither side of a task
grows with the table. Equal vectors cannot be told apart by any split and are
halved by position, so a group of copies is as harmless as other rows.

Vectors that are null, all zero, or hold null or non-finite components take
no part, nor do rows with a null id. Vectors meet only those of
equal length; of those with the same id the least one counts. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import prepare, shuffle_partitions, table
from encore.llm.vectors import block_no, blocks_of, every_block, finite_vector, matrix, meet, runs

SHARD_ROWS = 8192       # rows indexed by one forest
QUERY_GROUP = 16384     # queries that one copy of a shard answers
TREES = 16
LEAF_ROWS = 32
# Rows met in leaves of all trees (a row counts once per tree), as a share of the shard. Set for vectors
# without any structure, whose neighbours are barely nearer than chance; clustered ones need far less.
BUDGET = 1.2
LEAST_MET = 2000        # rows met in leaves at least, however small the shard
BATCH = 256             # queries searched at once
KEYS = ["dim", "shard", "query_group"]


@dataclass
class Tree:
    """Splits in order of creation (a parent before its children); leaves by row."""

    directions: np.ndarray      # (splits, dim)
    thresholds: np.ndarray
    parents: np.ndarray         # of split or leaf: the split above it (-1: none)
    signs: np.ndarray           # -1: it lies below the threshold of its parent, 1: at or above it
    n_splits: int
    leaf_of_row: np.ndarray
    leaf_sizes: np.ndarray


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Every row divided by its length; powers of two keep the squares in range and change no digit."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grow(unit: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of `unit`: halves at the median of a projection, down to `leaf_rows` rows."""
    directions, thresholds, split_at, leaf_at, leaves = [], [], [], [], []
    waiting = [(np.arange(len(unit)), -1, 0)]
    while waiting:
        rows, parent, sign = waiting.pop()
        if len(rows) <= leaf_rows:
            leaf_at.append((parent, sign))
            leaves.append(rows)
            continue
        a, b = rng.choice(rows, 2, replace=False)
        way = unit[a] - unit[b]
        if not way.any():
            way = rng.standard_normal(unit.shape[1])
        way = way / np.sqrt((way * way).sum())
        along = unit[rows] @ way
        half = len(rows) // 2
        order = np.argpartition(along, half)
        split_at.append((parent, sign))
        directions.append(way)
        thresholds.append((along[order[:half]].max() + along[order[half]]) / 2)
        at = len(directions) - 1
        waiting += [(rows[order[:half]], at, -1), (rows[order[half:]], at, 1)]
    above = np.array([*split_at, *leaf_at], np.int64).reshape(-1, 2)
    leaf_of_row = np.empty(len(unit), np.int64)
    for k, rows in enumerate(leaves):
        leaf_of_row[rows] = k
    return Tree(np.array(directions).reshape(-1, unit.shape[1]), np.array(thresholds), above[:, 0],
                above[:, 1].astype(np.float64), len(directions), leaf_of_row, np.array([len(r) for r in leaves]))


def leaf_priorities(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """(leaves, queries): how far each query lies beyond the worst split on the way to each leaf."""
    worst = np.full((len(tree.parents), len(queries)), -np.inf)
    if tree.n_splits:
        margin = tree.directions @ queries.T - tree.thresholds[:, None]
        for node in range(len(tree.parents)):
            up = tree.parents[node]
            if up >= 0:
                # below the threshold is where the margin is negative
                np.maximum(worst[up], -tree.signs[node] * margin[up], out=worst[node])
    return worst[tree.n_splits:]


class Forest:
    """The index of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, leaf_rows: int, seed: int):
        self.ids, self.unit = ids, unit_rows(vectors)
        rng = np.random.default_rng(seed)
        self.trees = [grow(self.unit, leaf_rows, rng) for _ in range(trees)]
        self.sizes = np.concatenate([t.leaf_sizes for t in self.trees])
        starts = np.cumsum([0] + [len(t.leaf_sizes) for t in self.trees])[:-1]
        self.leaf_of_row = np.stack([t.leaf_of_row + s for t, s in zip(self.trees, starts)])

    def candidates(self, queries: np.ndarray, budget: float) -> np.ndarray:
        """(queries, rows): the rows in the leaves that each query opens."""
        urgency = np.concatenate([leaf_priorities(t, queries) for t in self.trees]).T
        queue = np.argsort(urgency, axis=1, kind="stable")
        met = np.cumsum(self.sizes[queue], axis=1)
        opened = np.zeros(urgency.shape, bool)
        np.put_along_axis(opened, queue, met - self.sizes[queue] < budget, axis=1)
        found = np.zeros((len(queries), len(self.ids)), bool)
        for leaves in self.leaf_of_row:
            found |= opened[:, leaves]
        return found

    def search(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, budget: float):
        """(query id, row id, cosine) of the k best candidates of every query, ties to the smaller id."""
        queries = unit_rows(vectors)
        for at in range(0, len(queries), BATCH):
            part = queries[at:at + BATCH]
            for one, who, rows in zip(part, query_ids[at:at + BATCH], self.candidates(part, budget)):
                rows = np.flatnonzero(rows & (self.ids != who))
                near = self.unit[rows] @ one
                if len(rows) > k:      # all that rounding could bring among the best
                    rows = rows[near >= np.partition(near, len(near) - k)[-k] - 1e-9]
                # the same sum in the same order for every pair, wherever its rows lie
                exact = (self.unit[rows] * one).sum(axis=1)
                best = np.lexsort((self.ids[rows], -exact))[:k]
                yield np.full(len(best), who), self.ids[rows[best]], exact[best]


def nearest(frame: DataFrame, k: int = 5, query_mod: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, query_group: int = QUERY_GROUP, trees: int = TREES,
            leaf_rows: int = LEAF_ROWS, budget: float = BUDGET, least_met: int = LEAST_MET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `query_mod`."""
    spark = frame.sparkSession
    prepare(spark)
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & finite_vector(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    is_query = F.col("id") % query_mod == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, groups = blocks_of(n, shard_rows), blocks_of(n_queries, query_group)
    rows = rows.withColumn("dim", F.size("vector")).withColumn("label", F.lit(0))
    held = rows.withColumn("shard", block_no(F.col("id"), shards)).withColumn("query_group", every_block(groups))
    asked = (rows.where(is_query).withColumn("query_group", block_no(F.col("id"), groups))
             .withColumn("shard", every_block(shards)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, forest = None, [], [], None
        for key, kind, part in runs(batches, KEYS):
            if key != at:
                at, ids, vectors, forest = key, [], [], None
            part_ids, part_vectors = part.column("id").to_numpy(), matrix(part.column("vector"))
            if kind == 0:
                ids.append(part_ids)
                vectors.append(part_vectors)
                continue
            if not ids:
                continue
            if forest is None:
                forest = Forest(np.concatenate(ids), np.concatenate(vectors), trees, leaf_rows, key[1])
                vectors = []
            rows_to_meet = max(budget * len(forest.ids), least_met)
            found = list(forest.search(part_ids, part_vectors, k, rows_to_meet))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 ["query_id", "vec_id", "score"])

    best = meet(held, asked, KEYS, shuffle_partitions(spark)).mapInArrow(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op12_ann_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
