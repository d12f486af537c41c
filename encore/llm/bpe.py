"""Byte-level BPE encoding and decoding over a corpus.

Encoding is a distinct-word shuffle (`blocks`): texts are split by the
tokenizer's pattern with positions, every distinct pre-token of the corpus is
merged once in its hash bucket, the ids come back to the blocks and are put
together by position. Decoding is a map-side join of the ids with the
token-byte table, which is bounded by the vocabulary and broadcast.

Null text counts as empty, an empty text has no tokens. Every input row gives
one output row (repeated rows and null ids too). Extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm import blocks as B
from encore.llm.common import SMALL_BATCH, prepare, shuffle_partitions, table

MAX_VOCABULARY = 1_000_000  # entries of a rank file; the proven bound of what is broadcast


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line per token, base64 bytes and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} entries; a vocabulary of at most {MAX_VOCABULARY} is broadcast")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: adjacent parts of the lowest rank are joined first."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            return [ranks[p] for p in parts]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and a linked list: n log n for long runs."""
    import heapq

    n = len(piece)
    start, end = list(range(n)), list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue                                  # one side has changed since
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i:end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i]))
    return [ranks[piece[start[i]:end[i]]] for i in range(n) if alive[i]]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), a row per input row."""
    spark = docs.sparkSession
    prepare(spark, SMALL_BATCH)
    partitions = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def splitter(text, compiled={}):  # noqa: B006  one compiled pattern per worker
        if pattern not in compiled:
            compiled[pattern] = regex.compile(pattern)
        if len(text) > B.LONG_TEXT:
            return (m.group() for m in compiled[pattern].finditer(text))
        return compiled[pattern].findall(text)

    def answer(rows):
        ids_of, table_ = {}, shared.value             # each distinct word of the bucket once
        for block, bucket, payload in rows:
            numbers, words = B.split_payloads(payload)
            found = []
            for w in B.unpack_words(words):
                ids = ids_of.get(w)
                if ids is None:
                    ids = ids_of[w] = merge(w, table_)
                found.append(ids)
            lens = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lens.sum()))
            yield {"key": -1 - block, "block": block, "kind": B.WORDS, "bucket": bucket,
                   "payload": B.pack(B.unpack(numbers)[0], lens, flat)}

    def start(payloads):
        parts = [B.unpack(p) for p in payloads]
        if not parts:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        numbers = np.concatenate([np.cumsum(p[0]) for p in parts])
        lens, flat = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        begin, size = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
        begin[numbers], size[numbers] = at[:-1], lens
        return begin, flat, size

    def finish(book, doc_ids, flags, lens, numbers):
        begin, flat, size = book
        bounds = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        n = size[numbers]
        ends = np.cumsum(n)
        # position of every id in `flat`: its word's start plus its place in the word
        at = np.repeat(begin[numbers] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
        ids = pa.array(flat[at].astype(np.int32))
        yield [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), ids)]

    dealt = B.deal(B.split_blocks(docs, id_col, text_col, splitter, 4 * partitions), partitions)
    answers = B.by_bucket(dealt, answer)
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return B.assemble(answers, dealt, start, finish, "doc_id long, ids array<int>", arrow)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the bytes of the row's ids, in order; null ids give no bytes.

    The token-byte table is at most MAX_VOCABULARY rows, so it is broadcast
    and joined in place. An id that it lacks raises an error.
    """
    prepare(encoded.sparkSession, SMALL_BATCH)
    by_id = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    shared = encoded.sparkSession.sparkContext.broadcast(by_id)

    def run(batches):
        token = shared.value.__getitem__
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            decoded = pa.array([b"".join(map(token, x.values.to_numpy().tolist())) if x.is_valid else b""
                                for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded],
                                             names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    ranks = read_ranks(path)
    both = decode(encode(docs, ranks, pattern), ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"),
                   public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
