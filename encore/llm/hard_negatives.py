"""Hard negatives by a secondary sort.

Every anchor meets every row in blocks (a task holds a block of anchors and
streams a block of rows past it; scores are matrix products). A first pass
finds the anchors' positives, a second one the negatives inside the positives'
score windows. A task passes on what can still be among the first of the
whole table: per anchor its best positives, per positive the best negatives of
its window. These pair scores are packed into keys (anchor, descending score,
positives first, id), dealt by anchor and sorted within partitions. An
iterator walks the keys: a positive opens a window, a negative is emitted to
every open window that its score lies in, and windows close when they are full
or the scores have sunk below them. No anchor is ever held as a whole, and
whatever share of the rows an anchor's label has, it sends a bounded number of
keys per block.

Rows with a null id, label or vector, or with null or non-finite components,
take no part. Vectors meet only those of equal length; of
those with the same id the one of the least label, then vector, counts. Scores beyond 64 bits
are the nearest 64-bit number. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.common import land, prepare, shuffle_partitions, table
from encore.llm.vectors import block_no, blocks_of, every_block, finite_vector, matrix, meet, runs

ANCHOR_BLOCK = 16384    # anchors that a task holds
ROW_BLOCK = 32768       # rows that it streams past them
CELLS = 1 << 22         # pair scores at once
KEYS = ["dim", "anchor_block", "row_block"]
PACKED = ">QQBQ"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def pack(anchor: int, score: int, negative: bool, other: int) -> bytes:
    """A key whose byte order is anchor, score from the highest, positives before negatives, id."""
    return struct.pack(PACKED, anchor - LEAST, MOST - score, negative, other - LEAST)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, other = struct.unpack(PACKED, key)
    return anchor + LEAST, MOST - score, bool(negative), other + LEAST


def by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def window_bounds(score, low: int, high: int):
    """Least and greatest integer n with low * score <= 100 * n <= high * score."""
    tens, ones = score // 100, score % 100
    return tens * low + -(-(ones * low) // 100), tens * high + ones * high // 100


def open_windows(keys: Iterable[tuple[bytes, None]], positives: int, negatives: int, low: int,
                 high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) out of one partition's sorted keys."""
    at, opened, windows = None, 0, []
    for key, _ in keys:
        anchor, score, negative, other = unpack(key)
        if anchor != at:
            at, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([other, score, *window_bounds(score, low, high), 0])
            continue
        windows = [w for w in windows if w[4] < negatives and score >= w[2]]
        for w in windows:
            if score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], other, w[1], score


def pair_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(anchors, rows): exact integer inner products."""
    reach = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if reach < 2.0 ** 53:
        return (anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)
    wide = np.array([[int(x) for x in a] for a in anchors], object).reshape(anchors.shape) @ exact.T
    return np.clip(wide, LEAST, MOST).astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of every group, by score from the highest, then id."""
    order = np.lexsort((ids, ~score, group))    # ~ reverses the order without overflow
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return order[np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)])) < k]


class Best:
    """The k best (score, id) of every group among what was offered so far."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, LEAST, np.int64)
        self.group, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(c) for c in (
            (self.group, group), (self.score, score), (self.ids, ids)))
        keep = first_of(group, score, ids, self.k)
        self.group, self.score, self.ids = group[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) == self.k)
        worst = np.full(len(self.least), MOST, np.int64)
        np.minimum.at(worst, self.group, self.score)
        self.least[full] = worst[full]


def _scored(frame: DataFrame, id_col: str, label_col: str, vector_col: str, flip_mod: int, n_labels: int) -> DataFrame:
    """id, label, vector of the rows that take part."""
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite_vector(F.col("vector")))
    if flip_mod:
        rows = rows.withColumn("label", F.when(F.col("id") % flip_mod == 0, (F.col("label") + 1) % n_labels)
                               .otherwise(F.col("label")))
    return rows


def _against_all(rows: DataFrame, anchors: DataFrame, found, schema: str) -> DataFrame:
    """`found(anchor rows, batches of rows)` over every pair of an anchor block and a row block."""
    spark = rows.sparkSession
    n, n_anchors = rows.count(), anchors.count()
    anchor_blocks, row_blocks = blocks_of(n_anchors, ANCHOR_BLOCK), blocks_of(n, ROW_BLOCK)
    held = (anchors.withColumn("dim", F.size("vector")).withColumn("anchor_block", block_no(F.col("id"), anchor_blocks))
            .withColumn("row_block", every_block(row_blocks)))
    passing = (rows.withColumn("dim", F.size("vector")).withColumn("row_block", block_no(F.col("id"), row_blocks))
               .withColumn("anchor_block", every_block(anchor_blocks)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, state = None, [], None
        for key, kind, part in runs(batches, KEYS):
            if key != at:
                if state is not None:
                    yield from state.result()
                at, parts, state = key, [], None
            if kind == 0:
                parts.append(part)
                continue
            if not parts:
                continue
            if state is None:
                state = found(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
            step = max(1, CELLS // len(state.ids))
            for a in range(0, part.num_rows, step):
                state.meet(part.slice(a, step))
        if state is not None:
            yield from state.result()

    return meet(held, passing, KEYS, shuffle_partitions(spark)).mapInArrow(walk, schema)


class _Anchors:
    """A block of anchors: ids, labels and whole-number vectors."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        self.numbers = np.floor(256 * matrix(batch.column("vector")))

    def scores(self, rows: pa.RecordBatch):
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        scores = pair_scores(self.numbers, np.floor(256 * matrix(rows.column("vector"))))
        return ids, self.labels[:, None] == labels, scores

    def emit(self, best: Best, per_anchor: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.ids[best.group // per_anchor], best.score, best.ids)],
            ["anchor_id", "score", "other_id"])


class _Positives(_Anchors):
    def __init__(self, batch: pa.RecordBatch, k: int):
        super().__init__(batch)
        self.best = Best(len(self.ids), k)

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, same, scores = self.scores(rows)
        a, r = np.nonzero(same & (scores >= self.best.least[:, None]) & (self.ids[:, None] != ids))
        self.best.offer(a, scores[a, r], ids[r])

    def result(self):
        return self.emit(self.best, 1)


class _Negatives(_Anchors):
    """Per anchor and positive, the first negatives of the positive's window."""

    def __init__(self, batch: pa.RecordBatch, positives: int, k: int, low: int, high: int):
        super().__init__(batch)
        self.per_anchor = positives
        scores = batch.column("positive_scores")
        at = np.repeat(np.arange(len(self.ids)), pc.list_value_length(scores).to_numpy())
        no = np.arange(len(at)) - np.searchsorted(at, at)
        # no positive: a window that nothing lies in
        self.low, self.high = np.full((positives, len(self.ids)), MOST), np.full((positives, len(self.ids)), LEAST)
        self.low[no, at], self.high[no, at] = window_bounds(scores.flatten().to_numpy(), low, high)
        self.best = Best(len(self.ids) * positives, k)

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, same, scores = self.scores(rows)
        for j in range(self.per_anchor):
            least = np.maximum(self.low[j], self.best.least[j::self.per_anchor])
            a, r = np.nonzero(~same & (scores >= least[:, None]) & (scores <= self.high[j][:, None]))
            self.best.offer(a * self.per_anchor + j, scores[a, r], ids[r])

    def result(self):
        return self.emit(self.best, self.per_anchor)


def mine(frame: DataFrame, anchor_mod: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90, flip_mod: int = 0, n_labels: int = 10, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `anchor_mod`. The score of a
    row is its inner product with the anchor, over floor(256 * component). An
    anchor's positives are its first `positives` other rows of its label; a
    positive's negatives the first `negatives` rows of other labels with
    low * positive score <= 100 * negative score <= high * positive score
    (0 <= low <= high <= 100). Where `flip_mod` divides the id, the label is
    first moved on by one of `n_labels`.
    """
    spark = frame.sparkSession
    prepare(spark)
    rows = _scored(frame, id_col, label_col, vector_col, flip_mod, n_labels)
    anchors = rows.where(F.col("id") % anchor_mod == 0)
    pair = "anchor_id long, score long, other_id long"
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id")
    near = land(_against_all(rows, anchors, lambda batch: _Positives(batch, positives), pair)
                .withColumn("no", F.row_number().over(order)).where(F.col("no") <= positives), "positives")
    scores = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.reverse(F.sort_array(F.collect_list("score"))).alias("positive_scores"))
    far = _against_all(rows, anchors.join(scores, "id"),
                       lambda batch: _Negatives(batch, positives, negatives, low, high), pair)
    pairs = (near.select("anchor_id", "score", F.lit(False).alias("negative"), "other_id")
             .unionByName(far.distinct().withColumn("negative", F.lit(True))))
    keys = pairs.rdd.map(lambda p: (pack(p.anchor_id, p.score, p.negative, p.other_id), None))
    mined = (keys.repartitionAndSortWithinPartitions(shuffle_partitions(spark), by_anchor)
             .mapPartitions(lambda part: open_windows(part, positives, negatives, low, high)))
    return spark.createDataFrame(mined, T.StructType([
        T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()),
        T.StructField("rank", T.IntegerType()), T.StructField("negative_id", T.LongType()),
        T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())]))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), flip_mod=7)


SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.id AS anchor_id, r.id AS other_id, a.label = r.label AS same,
    CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id % 100 = 0 AND r.id <> a.id
), pos AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
    n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT * FROM ranked WHERE rank <= 10
"""
