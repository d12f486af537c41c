"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks. Two fingerprints that differ in at most
`max_bits` bits agree in at least `n_blocks - max_bits` blocks, so every such
set of blocks is a join key: fingerprints meet under a key and are verified
by Hamming distance there. Equal fingerprints are one vertex, so exact copies
cost nothing in the join.

A key's group is searched in its task from seed to unvisited neighbours and
yields the edges of a spanning forest, not all pairs. Groups over
`group_limit` distinct fingerprints (very dense copies) leave the task
unsearched, and are linked exactly by another way: fingerprints are within
3 bits if and only if a 64-bit value lies within 1 bit of one and 2 bits of
the other, so each sends itself to the values around it (a number of rows
linear in the group) and everything at a value is tied to one member that
lies within 1 bit of it.

The tables of links and the result are far smaller than the texts, and are
written in as many files as their rows fill, not in one for each partition of
a shuffle: Hadoop's local file system starts a process to set the rights of
every file and folder it makes, and until that process runs its own program it
counts as a second copy of the executor.

Null and empty texts have fingerprint zero and link like any other. A null
id keeps its row; its component is the least id reachable, or null if none
is known. Repeated rows give repeated output rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import SMALL_BATCH, land, prepare, shuffle_partitions, table
from encore.llm.components import FILE_EDGES, connected_components

SEED = 42
FLUSH = 200_000             # shingles summed at once
FILE_ROWS = 50_000          # rows of the result in a partition, about
# byte value -> its 8 bits in the 8 byte lanes of a 64-bit word
LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(text: str, length: int):
    """Lists of XXH64 of the text's shingles, at most FLUSH in each."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= length:
        yield [xxhash.xxh64_intdigest(joined, SEED)]
        return
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    stops = ends[length - 1:]
    for at in range(0, len(stops), FLUSH):
        yield [xxhash.xxh64_intdigest(joined[a:b], SEED)
               for a, b in zip(starts[at:at + FLUSH], stops[at:at + FLUSH])]


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(groups, 64): in how many hashes of each group every bit is set; no size is 0."""
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pieces = (sizes + 254) // 255                     # a byte lane holds 255 at most
    of = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = firsts[of] + 255 * nth
    group = np.cumsum(pieces) - pieces
    out = np.empty((len(sizes), 64), np.int64)
    for b in range(8):
        lanes = LANES[(hashes >> np.uint64(8 * b)) & np.uint64(255)]
        sums = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
        out[:, 8 * b:8 * b + 8] = np.add.reduceat(sums.astype(np.int64), group, axis=0)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every row, as a signed 64-bit integer."""
    prepare(docs.sparkSession, SMALL_BATCH)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def flush(ids, sizes, parts):
        sizes, fps = np.array(sizes, np.int64), np.zeros(len(sizes), np.uint64)
        if sizes.any():
            some = sizes > 0
            counts = bit_counts(np.concatenate(parts), sizes[some])
            ones = 2 * counts > sizes[some][:, None]
            fps[some] = (ones * weights).sum(axis=1, dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps.view(np.int64))],
                                          names=["doc_id", "fp"])

    def run(batches):
        ids, sizes, parts, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                sizes.append(0)
                for hashes in shingle_hashes(text.as_py() or "", shingle):
                    parts.append(np.array(hashes, np.uint64))
                    sizes[-1] += len(hashes)
                    held += len(hashes)
                if held >= FLUSH or len(ids) >= 10_000:
                    yield flush(ids, sizes, parts)
                    ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield flush(ids, sizes, parts)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def block_masks(n_blocks: int, max_bits: int) -> list[int]:
    """One mask for each set of blocks of which close pairs share at least one."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    ones = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(ones[i] for i in some) for some in combinations(range(n_blocks), n_blocks - max_bits)]


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the values within `max_bits` bits of each other."""
    edges, left = [], fps.copy()
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                edges += [(x, y) for y in found]
                todo += list(found)
    return edges


def links(distinct: DataFrame, max_bits: int = 3, n_blocks: int = 6,
          group_limit: int = 4096, most: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect what is within `max_bits` bits.

    `most`, if known, is the most rows of `distinct`; the edges are landed in
    as many files as the most edges of them fill.
    """
    if max_bits > 3:
        raise ValueError("dense groups are linked for at most 3 bits")
    partitions = shuffle_partitions(distinct.sparkSession)
    masks = np.array(block_masks(n_blocks, max_bits), np.uint64)

    def keys(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), i, np.int32)), pa.array((fps & mask).view(np.int64)),
                     batch.column(0)], names=["nth", "part", "fp"])

    def search(batches):
        def close(group):
            fps = np.array(group, np.int64).view(np.uint64)
            return [(int(a.view(np.int64)), int(b.view(np.int64)))
                    for a, b in forest(fps, max_bits)] if len(fps) > 1 else []

        key, group, dense, out = None, [], False, []
        for batch in batches:
            for nth, part, fp in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (nth, part) != key:
                    out += [] if dense else close(group)
                    key, group, dense = (nth, part), [], False
                if dense:
                    out.append((fp, None))
                else:
                    group.append(fp)
                    if len(group) > group_limit:      # leaves unsearched
                        out += [(x, None) for x in group]
                        group, dense = [], True
            if out:
                yield batch_of(out)
                out = []
        out += [] if dense else close(group)
        if out:
            yield batch_of(out)

    def batch_of(pairs):
        u, v = zip(*pairs)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                          names=["u", "v"])

    found = (distinct.select("fp").mapInArrow(keys, "nth int, part long, fp long")
             .repartition(partitions, "nth", "part").sortWithinPartitions("nth", "part")
             .mapInArrow(search, "u long, v long").distinct())
    if most is not None:      # a fingerprint has an edge of its own, or a null, under each mask
        found = found.coalesce(max(1, -(-most * len(masks) // FILE_EDGES)))
    found = land(found, "simhash-links")
    linked, rows = found.agg(F.count("v"), F.count("*")).first()
    if linked == rows:
        return found
    dense = found.where("v is null").select(F.col("u").alias("fp"))
    around = (rows - linked) * sum(comb(64, r) for r in range(max_bits - max_bits // 2 + 1))
    tied = land(_dense_links(dense, max_bits).coalesce(-(-around // FILE_EDGES)), "simhash-dense")
    return found.where("v is not null").union(tied).distinct()


def _dense_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges that connect values within `max_bits` (3 at most) bits, linear in their number."""
    near, far = max_bits // 2, max_bits - max_bits // 2
    flips = [(r, sum(1 << b for b in bits)) for r in range(far + 1)
             for bits in combinations(range(64), r)]
    radius = np.array([r for r, _ in flips], np.int32)
    flip = np.array([m for _, m in flips], np.uint64)

    def around(batches):
        for batch in batches:
            for fp in batch.column(0).to_numpy().view(np.uint64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((fp ^ flip).view(np.int64)), pa.array(radius),
                     pa.array(np.full(len(flip), fp).view(np.int64))], names=["at", "radius", "fp"])

    sent = fps.mapInArrow(around, "at long, radius int, fp long")
    tied = (sent.groupBy("at").agg(F.min(F.when(F.col("radius") <= near, F.col("fp"))).alias("hub"),
                                   F.count("*").alias("n")).where("hub is not null and n > 1"))
    return (sent.join(tied, "at").where("fp != hub")
            .select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, n_blocks: int = 6,
                    group_limit: int = 4096, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least id reachable."""
    fps = land(fingerprints(docs, shingle, id_col, text_col), "simhash")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(first, max_bits, n_blocks, group_limit, fps.count())
    roots = connected_components(edges, edges.count())
    rooted = (first.join(roots, first["fp"] == roots["vertex"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp", "left") \
        .select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    ).repartition(max(1, -(-docs.count() // FILE_ROWS)))
