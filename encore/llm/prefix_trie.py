"""Prefix trie of conversations over range shards.

A turn's id is 128 bits of a digest of its role and text; a conversation is
one row of turn ids. The rows are dealt by range of (turn ids, conversation
id) and sorted, so a shard, and each block of consecutive rows within it, is
a range of the trie's leaves, and copies of one conversation may lie in as
many blocks as they need. Each block is a padded matrix of turn ids: numpy
lexsort orders its rows, column change masks accumulated by OR mark where the
nodes of every depth start, reduceat aggregates all depths at once, and
subtree sums are differences of running sums in preorder.

Only nodes on the path of a block's first or last row can reach into another
block. A block lists these boundary nodes apart, with what it knows about
them without other boundary nodes: members, children, leaves and tokens below
them. They recombine in three small shuffles: pieces of a node are summed by
its path digest; back in their blocks, where they form a stem with two
branches, each gets what the boundary nodes that the block was the first to
meet add below it; these are summed by path again. Other nodes hanging
directly off a boundary node read its conversation id by (block, place). The
ids of conversations that end in a node travel as ready joined pieces, one per
block, in order; a node whose copies fill several blocks is hashed by
streaming them.

Defined cases: null ids take no part; null role or text is empty; turns are
ordered by (turn, nulls first), ties by the digest of role and text; repeated
rows are repeated turns; a conversation may have no turns left and ends in the
root. An empty table has no nodes. Extra columns are ignored. One
conversation's ids (16 bytes a turn) have to fit into a row and a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import land, prepare, shuffle_partitions, table

CELLS = 1 << 21         # padded turns of a block
BLOCK_ROWS = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

BLOCK_SCHEMA = ("block long, place int, parent_place int, depth long, conv_id long, parent_conv_id long, "
                "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, "
                "boundary_child boolean, path binary, ends string, n_ends long")
TOTALS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of id, words): the turns of every conversation in order."""
    said = F.concat(F.sha2(F.coalesce("role", F.lit("")).cast("binary"), 256),
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    turn_id = F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, 16)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    each = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", turn_id.alias("id"), words.alias("words")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"], t["words"]))
    return each.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation with the first h turns of the one that heads its group, h = crc32(id) mod `heads`."""
    head_of = F.col("conv_id") - F.col("conv_id") % group
    first = convs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    mine = convs.withColumn("head_id", head_of).withColumn("h", h).join(first, "head_id", "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(convs.schema["turns"].dataType))
    return mine.select("conv_id", F.concat(head, own).alias("turns"))


class Block:
    """Rows of one range of the trie as a padded matrix of turn ids."""

    def __init__(self, conv: np.ndarray, length: np.ndarray, ids: np.ndarray, words: np.ndarray):
        """`ids` ((turns, 16) bytes) and `words` hold the rows' turns one after another."""
        rank = np.unique(np.ascontiguousarray(ids).view("S16").ravel(), return_inverse=True)[1] + 1
        at = np.arange(length.max(initial=0)) < length[:, None]
        turns = np.zeros(at.shape, np.int32)
        turns[at] = rank
        words_at = np.zeros(at.shape, np.int32)
        words_at[at] = words
        place = np.zeros(at.shape, np.int64)
        place[at] = np.arange(len(rank))
        order = np.lexsort((conv, *turns.T[::-1]))
        self.conv, self.length, self.turns = conv[order], length[order], turns[order]
        self.words, self.place, self.ids = words_at[order], place[order], ids
        self._nodes()

    def _nodes(self) -> None:
        n, depths = len(self.conv), self.turns.shape[1]
        new = np.ones((n, depths + 1), bool)            # column 0: the root
        new[1:, 0] = False
        new[1:, 1:] = np.logical_or.accumulate(self.turns[1:] != self.turns[:-1], axis=1)
        cells = np.flatnonzero(new.T.ravel())           # prefix changes, depth by depth
        convs = np.minimum.reduceat(np.tile(self.conv, depths + 1), cells)
        members = np.diff(np.r_[cells, n * (depths + 1)])
        depth, row = cells // n, cells % n
        node = self.length[row] >= depth                # others are padding
        number = np.cumsum(node) - 1                    # of the node at a cell
        up = np.searchsorted(cells, cells - n, "right") - 1
        self.depth, self.row, self.conv_id, self.n_convs = depth[node], row[node], convs[node], members[node]
        self.parent = np.where(depth[node] > 0, number[up[node]], -1)
        self.n_children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.depth))
        self.node_words = np.where(self.depth > 0, self.words[self.row, np.maximum(self.depth, 1) - 1]
                                   if depths else 0, 0).astype(np.int64)
        # members that end in the node: the first rows of its range, all equal
        run = np.flatnonzero(np.r_[True, (self.length[1:] != self.length[:-1]) | new[1:, -1]])
        size = np.diff(np.r_[run, n])
        same_length = self.length[run]
        self.n_ends, self.end_row = np.zeros(len(self.depth), np.int64), np.zeros(len(self.depth), np.int64)
        at = np.searchsorted(cells, same_length * n + run, "right") - 1
        self.n_ends[number[at]], self.end_row[number[at]] = size, run
        # on the path of the first or last row
        self.boundary = (self.row == 0) | (self.row + self.n_convs == n)

    def below(self, value: np.ndarray) -> np.ndarray:
        """Sum of `value` over every node's subtree, itself included."""
        order = np.lexsort((self.depth, self.row))      # preorder
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        total = np.r_[0, np.cumsum(value[order])]
        end = np.searchsorted(self.row[order], self.row + self.n_convs, "left")
        return total[end] - total[where]

    def paths(self) -> dict[int, bytes]:
        """Digest of the path of every boundary node."""
        found = {}
        for row in {0, len(self.conv) - 1}:
            chain, digests = hashlib.sha256(), []
            digests.append(chain.digest()[:16])
            for turn in self.ids[self.place[row, :self.length[row]]]:
                chain.update(turn.tobytes())
                digests.append(chain.digest()[:16])
            here = np.flatnonzero(self.boundary & (self.row <= row) & (row < self.row + self.n_convs))
            found.update((i, digests[d]) for i, d in zip(here.tolist(), self.depth[here].tolist()))
        return found

    def joined(self, node: int) -> str:
        at = self.end_row[node]
        return ",".join(map(str, self.conv[at:at + self.n_ends[node]].tolist()))

    def result(self, number: int) -> pa.RecordBatch:
        """The block's nodes; sums of boundary nodes leave out what boundary nodes add themselves."""
        inner = ~self.boundary
        leaf = inner & (self.n_children == 0)
        saved = np.where(inner, (self.n_convs - 1) * self.node_words, 0)
        boundary_kids = np.bincount(self.parent[self.boundary & (self.parent >= 0)], minlength=len(self.depth))
        parent_inner = (self.parent >= 0) & inner[self.parent]
        paths = self.paths()
        ends = [None] * len(self.depth)
        for i in range(len(ends)):
            if inner[i]:
                ends[i] = hashlib.sha256(self.joined(i).encode()).hexdigest() if self.n_ends[i] else NOTHING
            elif self.n_ends[i]:
                ends[i] = self.joined(i)
        places = np.where(self.boundary, np.arange(len(self.depth)), -1)
        up = np.where((self.parent >= 0) & ~parent_inner, self.parent, -1)
        columns = [np.full(len(ends), number), places, up, self.depth, self.conv_id,
                   pa.array(np.where(parent_inner, self.conv_id[self.parent], 0), mask=~parent_inner),
                   self.n_convs, self.n_children - boundary_kids, self.below(leaf.astype(np.int64)), self.below(saved),
                   self.node_words, boundary_kids > 0, pa.array([paths.get(i) for i in range(len(ends))], pa.binary()),
                   pa.array(ends, pa.string()), self.n_ends]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.bool_(), pa.binary(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _cut(batches: Iterator[pa.RecordBatch], cells: int, rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows in blocks of at most `cells` padded turns and `rows` rows (or one row)."""
    held, n, deepest = [], 0, 0
    for batch in batches:
        length = batch.column("turns").value_lengths().to_numpy(zero_copy_only=False)
        a = 0
        while a < len(length):
            deep = np.maximum(np.maximum.accumulate(length[a:]), deepest) + 1
            count = np.arange(1, len(deep) + 1) + n
            fit = int(np.searchsorted((count > rows) | (count * deep > cells), True))
            if not fit and n:
                yield held
                held, n, deepest = [], 0, 0
                continue
            fit = max(fit, 1)
            held.append(batch.slice(a, fit))
            n, deepest, a = n + fit, int(deep[fit - 1]) - 1, a + fit
    if held:
        yield held


def _blocks(cells: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, held in enumerate(_cut((b for b in batches if b.num_rows), cells, rows)):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            turns = whole.column("turns").flatten()
            ids = b"".join(turns.field("id").to_pylist())
            yield Block(whole.column("conv_id").to_numpy(),
                        whole.column("turns").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                        np.frombuffer(ids, np.uint8).reshape(-1, 16),
                        turns.field("words").to_numpy(zero_copy_only=False)).result((part << 32) + k)
    return run


def _in_block(pieces: pd.DataFrame) -> pd.DataFrame:
    """What the boundary nodes that a block was the first to meet add below each of its boundary nodes."""
    p = pieces.sort_values(["depth", "place"]).reset_index(drop=True)
    at = {place: i for i, place in enumerate(p["place"])}
    up = [at.get(x, -1) for x in p["parent_place"]]
    created = (p["creator"] == p["block"]).to_numpy()
    own_saved = (p["all_convs"] - 1) * p["words"]
    leaves = np.where(created & p["is_leaf"], 1, 0).astype(np.int64)
    saved = np.where(created, own_saved, 0).astype(np.int64)
    kids, first = np.zeros(len(p), np.int64), p["all_conv_id"].to_numpy()
    parent_conv = np.full(len(p), -1, np.int64)
    for i in range(len(p) - 1, -1, -1):         # from the deepest: parents come before children
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
            kids[up[i]] += int(created[i])
            parent_conv[i] = first[up[i]]
    return pd.DataFrame({"block": p["block"], "place": p["place"], "path": p["path"], "conv_id": first,
                         "parent_conv_id": parent_conv,
                         "root": [u < 0 for u in up], "kids": kids, "leaves": leaves, "saved": saved})


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends_sha256) from pieces sorted by (path, block)."""
    at, state = None, None
    for batch in batches:
        done = []
        for path, piece in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
            if path != at:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = path, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                          pa.array([d[1] for d in done], pa.string())], ["path", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])],
                                         ["path", "ends_sha256"])


def trie(convs: DataFrame, cells: int = CELLS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    `convs` has conv_id (one row each) and turns (array of id binary(16), words int).
    """
    spark = convs.sparkSession
    prepare(spark)
    parts = shuffle_partitions(spark)
    ids = F.transform("turns", lambda t: t["id"])
    sharded = (convs.withColumn("ids", ids).repartitionByRange(parts, "ids", "conv_id")
               .sortWithinPartitions("ids", "conv_id").select("conv_id", "turns"))
    nodes = land(sharded.mapInArrow(_blocks(cells, block_rows), BLOCK_SCHEMA), "trie-blocks")
    pieces = nodes.where("place >= 0")
    whole = pieces.groupBy("path").agg(
        F.min("block").alias("creator"), F.min("conv_id").alias("all_conv_id"), F.sum("n_convs").alias("all_convs"),
        ((F.sum("n_children") == 0) & ~F.max("boundary_child")).alias("is_leaf"))
    local = land(
        pieces.select("block", "place", "parent_place", "depth", "words", "path").join(whole, "path")
        .groupBy("block").applyInPandas(_in_block, "block long, place int, path binary, conv_id long, "
                                        "parent_conv_id long, root boolean, kids long, leaves long, saved long"),
        "trie-pieces")
    more = local.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(~F.col("root"), F.col("parent_conv_id"))).alias("parent_conv_id"),
        F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = pieces.groupBy("path").agg(F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in TOTALS])
    ends = (pieces.where("n_ends > 0").select("path", "block", "ends").repartition(parts, "path")
            .sortWithinPartitions("path", "block").mapInArrow(_hash_ends, "path binary, ends_sha256 string"))
    edge = sums.join(more, "path").join(ends, "path", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.col("kids")).alias("n_children"),
        (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    # nodes inside a block; those right below a boundary node ask the block's piece of it
    inner = nodes.where("place < 0")
    names = local.select("block", F.col("place").alias("parent_place"), F.col("conv_id").alias("up_conv_id"))
    hanging = inner.where("parent_place >= 0").join(names, ["block", "parent_place"]).withColumn(
        "parent_conv_id", F.col("up_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *TOTALS, F.col("ends").alias("ends_sha256")]
    return (edge.unionByName(hanging.select(columns))
            .unionByName(inner.where("parent_place < 0").select(columns)))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM rows GROUP BY conv_id
), crc AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)),
      lambda x, y: xor(x // 2, (x % 2) * 3988292384::BIGINT + y)))) % 4 AS h
  FROM own
), seq AS (
  SELECT c.conv_id, coalesce(p.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM crc c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20
), steps AS (
  SELECT conv_id, d AS depth, len(turns) AS n, turns[d] AS last,
    sha256(list_transform(turns[1:d], lambda t: sha256(t.r) || sha256(t.t)).list_aggregate('string_agg', ',')) AS path
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM seq)
), node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM steps GROUP BY depth, path
), up AS (
  SELECT a.conv_id AS member, a.depth, n.conv_id FROM steps a JOIN node n ON n.depth = a.depth AND n.path IS NOT DISTINCT FROM a.path
), own_values AS (
  SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.ends_sha256,
    CASE WHEN n.depth = 0 THEN 0
      ELSE (n.n_convs - 1) * len(regexp_extract_all(n.last.t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM node n LEFT JOIN up u ON u.member = n.conv_id AND u.depth = n.depth - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM own_values WHERE depth > 0 GROUP BY 1, 2
), valued AS (
  SELECT o.*, coalesce(k.n, 0) AS n_children FROM own_values o LEFT JOIN kids k USING (conv_id, depth)
), below AS (
  SELECT u.conv_id, u.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v JOIN up u ON u.member = v.conv_id AND u.depth <= v.depth GROUP BY 1, 2
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM valued JOIN below USING (conv_id, depth)
"""
