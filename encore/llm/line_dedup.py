"""Near-duplicate lines by a segment-partition edit join.

A line repeats if the same line occurs earlier (by doc_id, then place), or a
line within `max_edits` edits (insertions, deletions, substitutions of code
points) first occurs earlier. Repeats are removed; the first occurrence
stays. Lines without a word and lines under `least_chars` code points are
left alone.

The join: every distinct line of a length is cut into `max_edits + 1`
segments, of which a line within `max_edits` edits must contain one
unchanged, near its place. So a line sends its segments to an index by
(length, number, content), and probes it, for each length it may match, with
the substrings at the few places where the shift on both sides stays within
the edits. Lines that meet are compared by a signature that every edit
changes little (the parity of each class of characters), and what is left is
verified by a bit-parallel edit distance over the band of `max_edits`
diagonals.

Blocks of texts send each distinct line once, whatever its number of
occurrences. Where a few lines share a key, their pairs are verified one by
one. A key that many lines share is split into chunks, and pairs of chunks are
searched in tasks of their own: a line tries the earlier ones in order until
one is near, so however many near copies a line has, a task says once that it
repeats. No pair is left out. What travels for the join are hashes; texts
follow only for lines that meet others.

Null texts count as empty. Rows with the same doc_id are one document: equal
rows give equal results. A null doc_id is before all others. An empty table
gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.common import SMALL_BATCH, land, prepare, shuffle_partitions, table

MAX_EDITS, LEAST_CHARS = 2, 24
BATCH_CHARS = 1_000_000     # characters of the lines sent, or searched, together (or one line)
HASH_CHARS = 200_000        # characters hashed at once (or one line): some fifteen words of 64 bits each
BLOCK_LINES, BLOCK_CHARS = 250_000, 16_000_000      # distinct lines, and their characters, of a task's block
FEW = 16                    # lines of a key that are paired as they meet; larger keys are searched
CHUNK = 2_000               # lines of a larger key compared with each other in one piece
LONG = 200                  # characters from which pairs are first freed of their common ends
PAIRS = 200_000             # pairs of lines compared, or measured, at once
AREA = 2_000_000            # characters of the pairs measured together (or one pair)
BROADCAST_ROWS = 200_000    # lines to fetch by a broadcast of their hashes, as counted; a shuffle beyond
FILE_IDS, FILE_LINES = 200_000, 5_000       # ids, or lines with their texts, of a landed file, about
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finisher that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def line_id(line: str) -> bytes:
    return xxhash.xxh128_digest(line.encode("utf-8", "surrogatepass"))


def short_id(identity: bytes) -> int:
    return int.from_bytes(identity[:8], "little", signed=True)


def wanted(line: str, least: int) -> bool:
    return len(line) >= least and bool(line.strip(" \t\r\x0b\x0c"))


def segment(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of `parts` of lines of n characters; longer segments last."""
    short, longer = n // parts, n % parts
    before = np.maximum(0, i - (parts - longer))
    return short * i + before, short + (i >= parts - longer)


def join_keys(lines: list[str], edits: int, least: int):
    """Yields (line numbers, keys, is it the index side) over a batch of lines."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points), BASE)]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points), INVERSE)]))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points + np.uint64(1)) * power[:-1])])
    first = np.cumsum(n) - n

    def hashed(of, start, size, length, i):
        a = first[of] + start
        part = (upto[a + size] - upto[a]) * back[a]
        return mix(mix(part) + (length * (edits + 1) + i).astype(np.uint64)).view(np.int64)

    every = np.arange(len(lines))
    for i in range(edits + 1):
        start, size = segment(n, i, edits + 1)
        yield every, hashed(every, start, size, n, i), True
        for fewer in range(edits + 1):
            length = n - fewer                        # of the lines looked for
            start, size = segment(length, i, edits + 1)
            # the shift is at most i edits on the left and edits - i on the right
            for shift in range(max(-i, fewer - (edits - i)), min(i, fewer + edits - i) + 1):
                ok = np.flatnonzero((length >= least) & (start + shift >= 0) & (start + shift + size <= n))
                yield ok, hashed(ok, (start + shift)[ok], size[ok], length[ok], i), False


def signatures(lines: list[str]) -> np.ndarray:
    """32 parities of character classes; an edit changes two at most."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bits = np.uint32(1) << (mix(points + np.uint64(7)) & np.uint64(31)).astype(np.uint32)
    return np.bitwise_xor.reduceat(bits, np.cumsum(n) - n).view(np.int32)


def wide_signatures(lines: list[str]) -> np.ndarray:
    """(lines, 2): 128 parities of character classes; an edit changes two at most."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    classes = mix(points + np.uint64(11)) & np.uint64(127)
    bits = np.uint64(1) << (classes & np.uint64(63))
    halves = [np.where(classes >> np.uint64(6) == h, bits, np.uint64(0)) for h in (0, 1)]
    return np.stack([np.bitwise_xor.reduceat(x, np.cumsum(n) - n) for x in halves], axis=1)


def banded_distance(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Edit distances of the pairs where they are at most `edits` (more otherwise).

    Bit-parallel over the band of 2 * edits + 1 diagonals: a word holds the
    vertical differences of a column, and each step moves it down one row.
    Many pairs advance together, a column at a time. The lengths of a pair
    must differ by at most `edits`.
    """
    order = sorted(range(len(a)), key=lambda i: len(b[i]))
    n = np.array([len(b[i]) for i in order])
    m = np.array([len(a[i]) for i in order])
    width = int(max(n.max(), m.max())) + 2 * edits + 2
    pattern = np.zeros((len(order), width), np.uint32)    # row r is at r + edits; 0 matches nothing
    text = np.full((len(order), int(n.max()) + 1), 0xFFFFFFFF, np.uint32)
    for row, i in enumerate(order):
        pattern[row, edits + 1:edits + 1 + m[row]] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        text[row, 1:1 + n[row]] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    one, top = np.uint64(1), 63
    # rows 1..edits of column 0 rise by one; rows before the pattern stay at zero differences
    vp = np.full(len(order), sum(1 << (top - q) for q in range(edits + 1)), np.uint64)
    vn = np.zeros(len(order), np.uint64)
    score = np.full(len(order), edits, np.int64)          # at (row column + edits, column)
    for j in range(1, int(n.max()) + 1):
        at = int(np.searchsorted(n, j))
        p, v = vp[at:], vn[at:]
        match = np.zeros(len(p), np.uint64)
        for q in range(2 * edits + 1):                    # bit top - q stands for row j + edits - q
            match |= (pattern[at:, j + 2 * edits - q] == text[at:, j]).astype(np.uint64) << np.uint64(top - q)
        d0 = (((match & p) + p) ^ p) | match | v
        hp, hn = v | ~(d0 | p), d0 & p
        score[at:] += 1 - (d0 >> np.uint64(top)).astype(np.int64)
        vp[at:] = hn | ~((d0 >> one) | hp)
        vn[at:] = (d0 >> one) & hp
    # from row n + edits up to row m by the differences between them
    between = n + edits - m
    mask = np.zeros(len(order), np.uint64)
    for q in range(1, 2 * edits + 1):
        mask |= np.where(between >= q, one << np.uint64(top - q), np.uint64(0))
    distance = score - np.bitwise_count(vp & mask).astype(np.int64) + np.bitwise_count(vn & mask).astype(np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = distance
    return out


def _lines_in_blocks(batches, least):
    """(line -> (doc_id, line_no) of its first occurrence) for each block of a task's documents."""
    seen: dict[str, tuple] = {}
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            at = (doc_id is not None, doc_id or 0)
            for no, line in enumerate((text.as_py() or "").split("\n")):
                if wanted(line, least):
                    place = (*at, no)
                    size += 0 if line in seen else len(line)
                    if line not in seen or place < seen[line]:
                        seen[line] = place
            if len(seen) >= BLOCK_LINES or size >= BLOCK_CHARS:
                yield seen
                seen, size = {}, 0
    if seen:
        yield seen


def _batches_of(lines: list[str]):
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size >= HASH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def first_places(docs: DataFrame, least: int) -> DataFrame:
    """(id, short, known, doc_id, line_no): where each distinct line first occurs."""
    def run(batches):
        for seen in _lines_in_blocks(batches, least):
            items = list(seen.items())
            for a in range(0, len(items), 50_000):
                part = items[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line_id(x) for x, _ in part], pa.binary()),
                     pa.array([p[0] for _, p in part]), pa.array([p[1] for _, p in part], pa.int64()),
                     pa.array([p[2] for _, p in part], pa.int32())], names=["id", "known", "doc_id", "line_no"])

    return (docs.mapInArrow(run, "id binary, known boolean, doc_id long, line_no int").groupBy("id")
            .agg(F.min(F.struct("known", "doc_id", "line_no")).alias("place")))


def meetings(docs: DataFrame, edits: int, least: int, few: int) -> DataFrame:
    """Lines that meet under a key: (a, b), a < b, short ids of lines with close
    signatures where up to `few` lines share it; the rows (a, key, sig, index) of larger keys, with a null b."""
    partitions = shuffle_partitions(docs.sparkSession)

    def keys(batches):
        for seen in _lines_in_blocks(batches, least):
            for lines in _batches_of(list(seen)):
                ids = np.array([short_id(line_id(x)) for x in lines], np.int64)
                sig = signatures(lines)
                for of, key, index in join_keys(lines, edits, least):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(ids[of]), pa.array(sig[of]),
                         pa.array(np.full(len(of), index))], names=["key", "line", "sig", "index"])

    def pairs_of(line, sig, index):
        i, k = close_signatures(sig[index], sig[~index], edits)
        a, b = line[index][i], line[~index][k]
        ok = a != b
        return np.unique(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], axis=1), axis=0)

    names = ["a", "b", "key", "sig", "index"]

    def meet(batches):
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, bool)]
        passing = None      # the last key of the flush before, if its rows were passed on

        def flush(key, line, sig, index):
            nonlocal passing
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            size = ends - starts
            ones = np.add.reduceat(index.astype(np.int64), starts)
            # most keys are one line that meets itself
            several = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
            large = size > few
            # only the first key can have begun before, only the last can go on: one side or line of it may be elsewhere
            open_ended = np.zeros(len(starts), bool)
            open_ended[0] = passing is not None and key[0] == passing
            large[0] |= open_ended[0]
            open_ended[-1] |= large[-1]
            passing = int(key[-1]) if large[-1] else None
            go = several & (ones > 0) & (ones < size) | open_ended
            rows = np.repeat(go & large, size)
            if rows.any():
                n = int(rows.sum())
                yield pa.RecordBatch.from_arrays([pa.array(line[rows]), pa.nulls(n, pa.int64()), pa.array(key[rows]),
                                                  pa.array(sig[rows]), pa.array(index[rows])], names=names)
            small = [pairs_of(line[x:y], sig[x:y], index[x:y])
                     for x, y in zip(starts[go & ~large].tolist(), ends[go & ~large].tolist())]
            if small:
                pairs = np.concatenate(small)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                     *(pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.bool_()))], names=names)

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            key, line, sig, index = (np.concatenate(x) for x in zip(held, new))
            # the last key may go on in the next batch; of a large one, pass on what there is
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if len(key) - last > few:
                last = len(key)
            if last:
                yield from flush(key[:last], line[:last], sig[:last], index[:last])
            held = [x[last:] for x in (key, line, sig, index)]
        if len(held[0]):
            yield from flush(*held)

    return (docs.mapInArrow(keys, "key long, line long, sig int, index boolean")
            .repartition(partitions, "key").sortWithinPartitions("key")
            .mapInArrow(meet, "a long, b long, key long, sig int, index boolean"))


def close_signatures(a: np.ndarray, b: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the signatures that `edits` edits can make of each other."""
    found = []
    for x in range(0, len(a), 256):
        i, k = np.nonzero(np.bitwise_count((a[x:x + 256, None] ^ b[None, :]).view(np.uint32)) <= 2 * edits)
        found.append((i + x, k))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def texts_of(docs: DataFrame, need: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """(short, id, line) of the lines whose short ids `need` lists, landed; `most` is the most rows of `need`, if known."""
    need = need.distinct()
    need = land(need if most is None else need.coalesce(max(1, -(-most // FILE_IDS))), "lines-needed")
    wanted_lines = need.count()
    few = wanted_lines <= BROADCAST_ROWS
    chosen = docs.sparkSession.sparkContext.broadcast(
        {r.short for r in need.collect()} if few else None)

    def fetch(batches):
        only = chosen.value
        for seen in _lines_in_blocks(batches, least):
            part, size = [], 0
            for x in seen:
                identity = line_id(x)
                if only is None or short_id(identity) in only:
                    part.append((short_id(identity), identity, x))
                    size += len(x)
                    if size >= BATCH_CHARS:
                        yield rows_of(part)
                        part, size = [], 0
            if part:
                yield rows_of(part)

    def rows_of(part):
        a, b, c = zip(*part)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()),
                                           pa.array(c, pa.string())], names=["short", "id", "line"])

    lines = docs.mapInArrow(fetch, "short long, id binary, line string")
    if not few:
        lines = lines.join(need, "short", "left_semi")
    return land(lines.dropDuplicates(["id"]).coalesce(max(1, -(-wanted_lines // FILE_LINES))), "lines-texts")


def without_ends(a: str, b: str) -> tuple[str, str]:
    """Both without the beginning and the end that they share; their distance is the same."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    left = n - start
    differ = np.flatnonzero(x[len(x) - left:][::-1] != y[len(y) - left:][::-1])
    end = int(differ[0]) if len(differ) else left
    return a[start:len(a) - end], b[start:len(b) - end]


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Which pairs are within `edits` edits, measured in groups of like length and bounded area."""
    out = np.zeros(len(a), bool)
    order = [i for i in range(len(a)) if abs(len(a[i]) - len(b[i])) <= edits]
    if any(len(a[i]) > LONG for i in order):
        a, b = list(a), list(b)
        for i in order:
            if len(a[i]) > LONG:
                a[i], b[i] = without_ends(a[i], b[i])
    # nothing left of one: as far apart as the other is long
    done = [i for i in order if not a[i] or not b[i]]
    out[done] = True
    order = sorted(set(order) - set(done), key=lambda i: len(a[i]))
    at = 0
    while at < len(order):
        # the pairs up to the first that would stretch the group beyond its area
        end = at + 1
        while end < len(order) and end - at < 4_096 and (end - at + 1) * len(a[order[end]]) <= AREA:
            end += 1
        part = order[at:end]
        out[part] = banded_distance([a[i] for i in part], [b[i] for i in part], edits) <= edits
        at = end
    return out


def verified_links(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(id_a, id_b): the ids of lines within `edits` edits of each other, among the pairs."""
    a, b = (lines.toDF(x, f"id_{x}", f"line_{x}") for x in "ab")

    def verify(batches):
        for batch in batches:
            near = pa.array(within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits))
            yield batch.select(["id_a", "id_b"]).filter(near)

    return (pairs.join(a, "a").join(b, "b").select("id_a", "id_b", "line_a", "line_b")
            .mapInArrow(verify, "id_a binary, id_b binary"))


def candidates(rows: list[tuple], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(late, early): rows (sig, index, id, line, place) of a cell that are to be compared, the earliest
    ones of each late row first."""
    ids = [r[2] for r in rows]
    sig, index = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], bool)
    left, right = (np.flatnonzero(x).astype(np.int32) for x in (index, ~index))
    order = sorted(range(len(rows)), key=lambda r: (rows[r][4], ids[r]))
    rank, number = np.empty(len(rows), np.int32), np.empty(len(rows), np.int32)
    rank[order] = np.arange(len(rows))
    # the same line may stand on both sides: a pair of it is no pair
    number[order] = np.cumsum([0] + [ids[x] != ids[y] for x, y in zip(order, order[1:])])
    wide, found = None, []
    step = max(1, PAIRS // max(1, len(right)))
    for x in range(0, len(left), step):
        i, k = close_signatures(sig[left[x:x + step]], sig[right], edits)
        if not len(i):
            continue
        if wide is None:
            wide = np.concatenate([wide_signatures(part) for part in _batches_of([r[3] for r in rows])])
        i, k = left[x:x + step][i], right[k]
        ok = np.bitwise_count(wide[i] ^ wide[k]).sum(axis=1) <= 2 * edits
        ok &= number[i] != number[k]
        i, k = i[ok], k[ok]
        later = rank[i] > rank[k]
        found.append((np.where(later, i, k), np.where(later, k, i)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    late, early = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((rank[early], late))
    return late[order], early[order]


def search(ids: list[bytes], texts: list[str], late: np.ndarray, early: np.ndarray, edits: int) -> list[bytes]:
    """Ids of the late rows of several cells that are near one of their early rows."""
    found, step = set(), 1
    while len(late):
        # each line that is left tries its next `step` candidates
        start = np.flatnonzero(np.r_[True, late[1:] != late[:-1]])
        nth = np.arange(len(late)) - np.repeat(start, np.diff(np.r_[start, len(late)]))
        now = nth < step
        of, with_ = late[now], early[now]
        near = np.concatenate([within([texts[x] for x in of[a:a + PAIRS]], [texts[x] for x in with_[a:a + PAIRS]], edits)
                               for a in range(0, len(of), PAIRS)])
        hit = np.unique(of[near])
        found.update(ids[x] for x in hit)
        left_over = ~now & ~np.isin(late, hit)
        late, early, step = late[left_over], early[left_over], step * 2
    return sorted(found)


def repeats_under_large_keys(rest: DataFrame, lines: DataFrame, places: DataFrame, edits: int,
                             chunk: int) -> DataFrame:
    """(id): lines that meet an earlier one within `edits` edits under a key that many lines share.

    The index side and the probing side of a key meet in chunks of at most
    about `chunk` lines and BATCH_CHARS characters. In a task every line tries
    its candidates from the earliest on, and stops at the first that is near:
    at most one row per line and pair of chunks leaves it.
    """
    partitions = shuffle_partitions(rest.sparkSession)
    known = lines.join(places, "id").select("short", "id", "line", "place")
    rows = rest.select("key", F.col("a").alias("short"), "sig", "index")
    sizes = rows.join(lines.select("short", F.length("line").alias("chars")), "short").groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("chars") / BATCH_CHARS)).cast("int").alias("n"))
    each = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("short"), "n").cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = each.select("key", F.when(F.col("index"), F.col("own")).otherwise(F.col("other")).alias("i"),
                        F.when(F.col("index"), F.col("other")).otherwise(F.col("own")).alias("k"),
                        "short", "sig", "index").join(known, "short")

    def run(batches):
        cell, rows = None, []
        ids, texts, pairs, size = [], [], [], 0

        def close_cell():
            """Adds the cell's pairs to those that are searched together."""
            nonlocal size
            late, early = candidates(rows, edits)
            if len(late):
                pairs.append((late + len(ids), early + len(ids)))
                ids.extend(r[2] for r in rows)
                texts.extend(r[3] for r in rows)
                size += len(late) + sum(len(r[3]) for r in rows)

        def flush():
            nonlocal ids, texts, pairs, size
            found = search(ids, texts, *(np.concatenate(c) for c in zip(*pairs)), edits) if pairs else []
            ids, texts, pairs, size = [], [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["id"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "k", "sig", "index", "id", "line", "place")]
            for key, i, k, sig, index, identity, line, place in zip(*columns):
                if (key, i, k) != cell and rows:
                    close_cell()
                    rows = []
                    if size >= BATCH_CHARS:
                        yield from flush()
                cell = (key, i, k)
                rows.append((sig, index, identity, line, (place["known"], place["doc_id"], place["line_no"])))
        if rows:
            close_cell()
        yield from flush()

    return (cells.repartition(partitions, "key", "i", "k").sortWithinPartitions("key", "i", "k")
            .mapInArrow(run, "id binary"))


def kept_places(docs: DataFrame, edits: int = MAX_EDITS, least: int = LEAST_CHARS,
                chunk: int = CHUNK, few: int = FEW) -> DataFrame:
    """(known, doc_id, line_no) of the lines that stay, of those that are compared."""
    places = land(first_places(docs, least), "lines-first")
    met = land(meetings(docs, edits, least, few), "lines-met")
    pairs, rest = met.where("b is not null").select("a", "b").distinct(), met.where("b is null").distinct()
    lines = texts_of(docs, met.select(F.explode(F.array("a", "b")).alias("short")).where("short is not null"),
                     least, 2 * met.count())
    links = verified_links(pairs, lines, edits)
    a, b = (places.toDF(f"id_{x}", f"place_{x}") for x in "ab")
    later = F.when(F.col("place_a") > F.col("place_b"), F.col("id_a")).otherwise(F.col("id_b"))
    repeats = links.join(a, "id_a").join(b, "id_b").select(later.alias("id")).union(
        repeats_under_large_keys(rest, lines, places, edits, chunk)).distinct()
    return places.join(repeats, "id", "left_anti").select("place.*")


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = LEAST_CHARS, chunk: int = CHUNK, few: int = FEW,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` with the text rewritten, and n_lines, n_removed.

    Columns of `docs` with these two names are left out.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = kept_places(source, edits, least, chunk, few).groupBy(
        F.when(F.col("known"), F.col("doc_id")).alias("kept_id")).agg(F.collect_set("line_no").alias("kept"))
    # the row travels as one column, so its names clash with none of these
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(id_col).cast("long").alias("own_id"))
    both = whole.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")), "left").select(
        "row", F.col(f"row.`{text_col}`").alias("old"), "kept")

    def rewrite(batches):
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, keep in zip(batch.column("old").to_pylist(), batch.column("kept").to_pylist()):
                lines, keep = (text or "").split("\n"), set(keep or ())
                stay = [x for no, x in enumerate(lines) if no in keep or not wanted(x, least)]
                texts.append(None if text is None else "\n".join(stay))
                totals.append(len(lines))
                removed.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()),
                 pa.array(removed, pa.int64())], names=["row", "new", "n_lines", "n_removed"])

    out = both.mapInArrow(rewrite, T.StructType([
        both.schema["row"], T.StructField("new", T.StringType()), T.StructField("n_lines", T.LongType()),
        T.StructField("n_removed", T.LongType())]))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                        for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, no, x[no] AS line, length(x[no]) >= 24 AND regexp_matches(x[no], '[^ \t\r\x0B\x0C]') AS used FROM (
    SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS no
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), f AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS place FROM l WHERE used GROUP BY line
), near AS (
  SELECT DISTINCT a.line FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND b.place < a.place
  WHERE length(translate(a.line, 'aeio', '')) BETWEEN length(translate(b.line, 'aeio', '')) - 2
      AND length(translate(b.line, 'aeio', '')) + 2
    AND levenshtein(a.line, b.line) <= 2
), k AS (
  SELECT l.*, NOT used OR ((doc_id, no) = f.place AND near.line IS NULL) AS stays
  FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
