"""Corpus-wide work on distinct words, without a shuffle of all words.

Texts are split once, in blocks of bounded size. A block keeps each distinct
word once (the map-side pre-aggregation) and its documents as sequences of
block-local word numbers. Only the distinct words travel to their hash
bucket, where every word of the corpus is treated once; the answers travel
back to the blocks and are put in place by position.

    split_blocks   documents -> rows WORDS (block, bucket) and DOCS (block)
    deal           both kinds in one exchange, by bucket or by block
    by_bucket      WORDS rows -> per-word answers, one task per hash bucket
    assemble       answers + DOCS rows of a block -> rows per document

`by_bucket` and `assemble` read the same exchange, so texts are split once.
Rows are put in a fixed order before they are numbered: a map task that runs
again after the loss of an executor writes the same blocks.

A very frequent word is one entry per block, so no word makes a hot key;
rows are bounded by the block size, tasks by the number of buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, DOCS = 0, 1
SCHEMA = ("key long, block long, kind int, bucket int, doc_ids array<bigint>, flags array<boolean>, "
          "lens array<int>, payload binary")
ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()),
                   ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
                   ("lens", pa.list_(pa.int32())), ("payload", pa.binary())])
LONG_TEXT = 4_000_000       # longer texts are split by an iterator, not one list
CHUNK_TOKENS = 500_000      # tokens in one DOCS row


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays as byte planes (low bytes first), compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u4")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if a.size else 1
        planes = a.view(np.uint8).reshape(-1, 4)[:, :width].T
        parts += [a.size.to_bytes(8, "little"), bytes([width]), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 0
    while at < len(raw):
        n, width = int.from_bytes(raw[at:at + 8], "little"), raw[at + 8]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        a = np.zeros((n, 4), np.uint8)
        a[:, :width] = planes.T
        out.append(a.view("<u4").ravel())
        at += 9 + n * width
    return out


def pack_words(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    head = pack(lens)
    body = zstandard.compress(b"".join(words), 3)
    return len(head).to_bytes(4, "little") + head + body


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    lens, = unpack(data[4:4 + n])
    body = zstandard.decompress(data[4 + n:])
    ends = np.cumsum(lens).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def join_payloads(*parts: bytes) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(4, "little"), p))


def split_payloads(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 4], "little")
        out.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return out


class Numbering(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _numbers(numbering: Numbering, words) -> np.ndarray:
    if isinstance(words, list):
        return np.fromiter(map(numbering.__getitem__, words), np.uint32, len(words))
    parts, words = [np.zeros(0, np.uint32)], iter(words)
    while part := list(islice(words, 100_000)):
        parts.append(np.fromiter(map(numbering.__getitem__, part), np.uint32, len(part)))
    return np.concatenate(parts)


def _counts(seqs: list[np.ndarray], n: int) -> np.ndarray:
    """How often each of n numbers occurs; about CHUNK_TOKENS numbers are counted at once."""
    out, part, size = np.zeros(n, np.int64), [], 0
    for i, s in enumerate(seqs):
        part.append(s)
        size += len(s)
        if size >= CHUNK_TOKENS or i + 1 == len(seqs):
            out += np.bincount(np.concatenate(part), minlength=n)
            part, size = [], 0
    return out


def _close(block: int, numbering: Numbering, seqs: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block: its words by bucket, its documents by chunk."""
    words = list(numbering)
    seen = _counts([s for _, _, s in seqs], len(words))
    counts = seen if all(flag for _, flag, _ in seqs) else _counts([s for _, flag, s in seqs if flag], len(words))
    order = np.argsort(-seen, kind="stable")
    rank = np.empty(len(words), np.uint32)           # frequent words get small numbers
    rank[order] = np.arange(len(words), dtype=np.uint32)
    raw = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in words]
    of = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
    rows = []
    by = np.lexsort((rank, of))
    edges = np.flatnonzero(np.diff(of[by], prepend=-1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(by)]):
        ids, bucket = by[a:b], int(of[by[a]])
        rows.append((bucket, block, WORDS, bucket, None, None, None, join_payloads(
            pack(np.diff(rank[ids], prepend=np.uint32(0)), counts[ids]),
            pack_words([raw[i] for i in ids]))))
    chunk, size = [], 0
    for i, x in enumerate(seqs):
        chunk.append(x)
        size += len(x[2])
        if size >= CHUNK_TOKENS or i + 1 == len(seqs):
            rows.append((-1 - block, block, DOCS, None, [c[0] for c in chunk], [c[1] for c in chunk],
                         [len(c[2]) for c in chunk],
                         pack(rank[np.concatenate([c[2] for c in chunk])])))
            chunk, size = [], 0
    for a in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows[a:a + 256]), ARROW)], schema=ARROW)


def split_blocks(docs: DataFrame, id_col: str, text_col: str, splitter: Callable[[str], list],
                 buckets: int, train=None, block_chars: int = 16_000_000,
                 block_words: int = 1_000_000) -> DataFrame:
    """Rows WORDS and DOCS of every block.

    `splitter(text)` gives the words (str or bytes), as a list or, for texts
    over LONG_TEXT characters, any iterable. `train` is a boolean column: the
    words' counts in WORDS rows are taken over rows where it holds.
    """
    def run(batches):
        def fresh():
            return Numbering(), [], 0
        part, nth = TaskContext.get().partitionId(), 0
        numbering, seqs, size = fresh()
        for batch in batches:
            for doc_id, text, flag in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py() or ""
                seqs.append((doc_id.as_py(), flag.as_py(), _numbers(numbering, splitter(text))))
                size += len(text)
                if size >= block_chars or len(numbering) >= block_words:
                    yield from _close((part << 24) + nth, numbering, seqs, buckets)
                    nth += 1
                    numbering, seqs, size = fresh()
        if seqs:
            yield from _close((part << 24) + nth, numbering, seqs, buckets)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.coalesce(F.lit(True) if train is None else train, F.lit(False)).alias("flag"))
    return src.sortWithinPartitions("doc_id", F.xxhash64("text"), "flag").mapInArrow(run, SCHEMA)


def deal(split: DataFrame, partitions: int) -> DataFrame:
    """The one exchange of both kinds of rows, by `key`."""
    return split.repartition(partitions, "key")


def by_bucket(dealt: DataFrame, answer: Callable) -> DataFrame:
    """Answer the WORDS rows of each bucket.

    `answer(rows)` gets the rows of one bucket, each (block, bucket, payload),
    and yields output rows as dicts; an answer to a block has key -1 - block.
    """
    def grouped(rows):
        bucket, held = None, []
        for row in rows:
            if row[1] != bucket and held:
                yield held
                held = []
            bucket = row[1]
            held.append(row)
        if held:
            yield held

    def words(batches):
        for b in batches:
            b = b.filter(pc.equal(b.column("kind"), WORDS))
            yield from zip(*(b.column(n).to_pylist() for n in ("block", "bucket", "payload")))

    def run(batches):
        out = []
        for rows in grouped(words(batches)):
            for row in answer(rows):
                out.append(row)
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    # all columns, as `assemble` reads them: so that both read one exchange
    return dealt.sortWithinPartitions("key").mapInArrow(run, SCHEMA)


def assemble(answers: DataFrame, dealt: DataFrame, start: Callable, finish: Callable, schema: str,
             arrow: pa.Schema) -> DataFrame:
    """Bring a block's answers to its documents.

    `start(payloads)` turns the answer payloads of the block into its
    dictionary; `finish(dictionary, doc_ids, flags, lens, numbers)` gives the
    output columns of one DOCS row.
    """
    def run(answered: pa.Table, rows: pa.Table) -> pa.Table:
        batches, book = [], None
        for batch in rows.to_batches():
            for row in batch.to_pylist():
                if row["kind"] != DOCS:
                    return arrow.empty_table()        # a bucket's words, not a block
                if book is None:
                    book = start(answered.column("payload").to_pylist())
                numbers, = unpack(row["payload"])
                for columns in finish(book, row["doc_ids"], row["flags"], row["lens"], numbers):
                    batches.append(pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type)
                         for c, f in zip(columns, arrow)], schema=arrow))
        return pa.Table.from_batches(batches, schema=arrow)

    return (answers.where(F.col("kind") == WORDS).groupBy("key").cogroup(dealt.groupBy("key"))
            .applyInArrow(run, schema))
