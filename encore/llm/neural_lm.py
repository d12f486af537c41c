"""Language-model scoring with a log-bilinear neural model.

Corpus counts come from all training rows, by the distinct-word shuffle of
`blocks`: every distinct word's count is summed once in its hash bucket and
sent back to the blocks. On top of the counts, the text is a sequence of
symbols: the end of text, SHAPES classes of words by shape, and the most
frequent words, of which there are as many as the square root of the number
of distinct training words, so that the vocabulary grows with the corpus. Words outside it are targets and contexts through their class.

A log-bilinear model gives P(symbol | two symbols before): the prediction
vector is a linear map of the two context vectors, its score with a symbol a
dot product plus a bias. It is trained in numpy by noise-contrastive
estimation. The symbol trigrams of all training rows are counted into a table
that grows with the corpus and is dealt by hash into shares of about
SHARE_ROWS trigrams. In each round a task takes gradient steps over every
trigram of its shares, weighted by their counts, and the parameters are
averaged by the shares' counts. Shares, steps and seeds depend on the counts
alone, not on files, tasks or the cluster; sums are kept in fixed point, so
their order does not matter either. For scoring, batched matrix products over
the distinct contexts of a chunk give normalised log-probabilities.

A word of a shape class has, within the class, its count plus 1/2 over the
class total plus 1/2; the last half is the mass of unseen words. So the
model is normalised over all words, and the log10 probability of a text is
the sum over its tokens, the end included.

Null texts count as empty (one token, the end). Every input row gives one
output row; repeated rows count as often as they occur; a null id is a
training row like the empty id text. An empty table gives no rows; without
training rows the model is uniform over the end and the classes. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import blocks as B
from encore.llm.common import crc_mod, land, prepare, shuffle_partitions, table

SHAPES, END = 32, 0
FIRST_WORD = 1 + SHAPES              # symbols: the end, the classes, then words by frequency
DIM, NOISE, ROUNDS, BATCH, RATE = 16, 64, 3, 4096, 0.1
SHARE_ROWS = 200_000                 # trigrams in a share, about
LEAST_STEPS = 50                     # a round's steps in a share, however small
NORM_CELLS, NORM_KEPT = 4_000_000, 2_000_000   # cells of a product; normalisers a task remembers
FIXED = float(1 << 40)               # fixed point of averaged parameters
STATS = 2
END_WORD = b""
SPACE_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text: str):
    raw = text.encode("utf-8", "surrogatepass").lower()   # bytes: only A-Z change
    if len(text) > B.LONG_TEXT:
        return chain((m.group() for m in SPACE_SPLIT.finditer(raw)), [END_WORD])
    return [*raw.split(), END_WORD]


def shape(word: bytes) -> int:
    """Class of a word: four kinds by characters, eight by length."""
    kind = 0 if word.isalpha() else 3 if any(48 <= c < 58 for c in word) else 2 if word[-1:] < b"\x80" \
        and not word[-1:].isalnum() else 1
    return 8 * kind + min(7, len(word) // 2)


def _wide(a: np.ndarray) -> bytes:
    return B.pack(a & 0xFFFFFFFF, a >> 32)


def _narrow(data: bytes) -> np.ndarray:
    lo, hi = B.unpack(data)
    return lo.astype(np.int64) | (hi.astype(np.int64) << 32)


def n_words(distinct: int) -> int:
    """Words with a symbol of their own among `distinct` training words."""
    return min(distinct, math.ceil(math.sqrt(distinct)))


def count_words(dealt: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket its words with their corpus counts, and per bucket its statistics.

    A bucket names as many of its words as the whole corpus will have symbols,
    were the other buckets like this one; only its share of them is needed.
    """
    def answer(rows):
        total: dict[bytes, int] = {}
        for _, _, payload in rows:
            numbers, words = B.split_payloads(payload)
            for w, c in zip(B.unpack_words(words), B.unpack(numbers)[1].tolist()):
                total[w] = total.get(w, 0) + c
        shapes = {w: shape(w) for w in total if w != END_WORD}
        for block, bucket, payload in rows:
            numbers, packed = B.split_payloads(payload)
            words = B.unpack_words(packed)
            yield {"key": -1 - block, "block": block, "kind": B.WORDS, "bucket": bucket, "payload": B.join_payloads(
                B.pack(B.unpack(numbers)[0], np.array([shapes.get(w, 0) for w in words])),
                _wide(np.array([total[w] for w in words], np.int64)), packed)}
        seen = [(w, c) for w, c in total.items() if c]
        sums, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for w, c in seen:
            if w != END_WORD:
                sums[shapes[w]] += c
                kinds[shapes[w]] += 1
        top = sorted(((w, c) for w, c in seen if w != END_WORD), key=lambda x: (-x[1], x[0]))[:n_words(buckets * len(seen))]
        yield {"key": 0, "block": -1, "kind": STATS, "bucket": rows[0][1], "payload": B.join_payloads(
            _wide(np.array([sum(c for _, c in seen), len(seen), *sums, *kinds], np.int64)),
            _wide(np.array([c for _, c in top], np.int64)), B.pack_words([w for w, _ in top]))}

    return B.by_bucket(dealt, answer)


class Corpus:
    """Statistics of the training corpus: totals, the words with symbols, class totals."""

    def __init__(self, counted: DataFrame):
        def sums(batches):
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    v = _narrow(B.split_payloads(p)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int32()), pa.array(v)],
                                                     names=["i", "v"])

        def tops(batches):
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    _, counts, words = B.split_payloads(p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(B.unpack_words(words), pa.binary()), pa.array(_narrow(counts))],
                        names=["word", "n"])

        stats = counted.where(F.col("kind") == STATS).select("payload")
        got = dict(stats.mapInArrow(sums, "i int, v long").groupBy("i").agg(F.sum("v")).collect())
        v = np.array([got.get(i, 0) for i in range(2 + 2 * SHAPES)], np.int64)
        self.n, self.distinct = int(v[0]), int(v[1])
        mass = v[2:2 + SHAPES] + 0.5 * v[2 + SHAPES:]
        best = (stats.mapInArrow(tops, "word binary, n long")
                .orderBy(F.desc("n"), F.hex("word")).limit(n_words(max(0, self.distinct - 1))).collect())
        self.top = {bytes(w): FIRST_WORD + i for i, (w, _) in enumerate(best)}
        self.size = FIRST_WORD + len(best)
        for w, c in best:
            mass[shape(bytes(w))] -= c + 0.5
        self.class_mass = np.maximum(mass, 0) + 0.5


SEQ_SCHEMA = ("doc_ids array<bigint>, flags array<boolean>, lens array<int>, known array<int>, "
              "base array<double>, within array<double>, symbols binary")
SEQ_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
                       ("lens", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())),
                       ("base", pa.list_(pa.float64())), ("within", pa.list_(pa.float64())),
                       ("symbols", pa.binary())])


def sequences(counted: DataFrame, dealt: DataFrame, corpus: Corpus) -> DataFrame:
    """Chunks of documents as symbol sequences with their sums over the corpus counts."""
    top, mass = corpus.top, corpus.class_mass

    def start(payloads):
        parts = [B.split_payloads(p) for p in payloads]
        numbers = np.concatenate([np.cumsum(B.unpack(a)[0]) for a, _, _ in parts])
        shapes = np.concatenate([B.unpack(a)[1] for a, _, _ in parts])
        counts = np.concatenate([_narrow(b) for _, b, _ in parts])
        own = np.fromiter((END if w == END_WORD else top.get(w, -1)
                           for _, _, c in parts for w in B.unpack_words(c)), np.int64, len(numbers))
        tail = own < 0
        symbol, count, within = (np.empty(len(numbers), t) for t in (np.uint32, np.int64, np.float64))
        symbol[numbers] = np.where(tail, 1 + shapes, own)
        count[numbers] = counts
        within[numbers] = np.where(tail, np.log10((counts + 0.5) / mass[shapes]), 0.0)
        return symbol, np.log10(count + 0.5), count > 0, within

    def finish(book, doc_ids, flags, lens, numbers):
        symbol, logs, known, within = book
        firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        total = [np.add.reduceat(x[numbers], firsts) for x in (known.astype(np.int32), logs, within)]
        yield [[doc_ids], [flags], [lens], *([t.tolist()] for t in total), [B.pack(symbol[numbers])]]

    return B.assemble(counted, dealt, start, finish, SEQ_SCHEMA, SEQ_ARROW)


def contexts_of(symbols: np.ndarray, lens, size: int) -> np.ndarray:
    """The number of the two symbols before each place; END stands before the text."""
    firsts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    one = np.concatenate([[END], symbols[:-1]]).astype(np.int64)
    two = np.concatenate([[END, END], symbols[:-2]])[:len(symbols)].astype(np.int64)
    one[firsts] = two[firsts] = END
    two[firsts[np.array(lens) > 1] + 1] = END
    return two * size + one


def trigram_counts(seqs: DataFrame, size: int) -> DataFrame:
    """(code, n): symbol trigram counts of the training rows."""
    def summed(codes, ns):
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(ns), len(code)).astype(np.int64)

    def run(batches):
        codes, ns, held = [], [], 0
        for batch in batches:
            for flags, lens, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                symbols, = B.unpack(packed)
                code = contexts_of(symbols, lens, size) * size + symbols
                code, n = np.unique(code[np.repeat(np.array(flags, bool), lens)], return_counts=True)
                codes.append(code)
                ns.append(n)
                held += len(code)
                if held > 2 * SHARE_ROWS:
                    codes, ns = ([x] for x in summed(codes, ns))
                    held = len(codes[0])
                    if held > SHARE_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(ns[0])], names=["code", "n"])
                        codes, ns, held = [], [], 0
        if held:
            code, n = summed(codes, ns)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return (seqs.select("flags", "lens", "symbols").mapInArrow(run, "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n")))


def shares_of(counts: DataFrame) -> DataFrame:
    """(share, n, payload): the trigrams dealt by hash into shares of about SHARE_ROWS, in order of code."""
    n_shares = max(1, math.ceil(counts.count() / SHARE_ROWS))

    def one(table: pa.Table) -> pa.Table:
        code, n = (table.column(c).to_numpy() for c in ("code", "n"))
        order = np.argsort(code)
        return pa.table({"share": pa.array(table.column("share").to_numpy()[:1], pa.int32()),
                         "n": pa.array([int(n.sum())], pa.int64()),
                         "payload": pa.array([B.join_payloads(_wide(code[order]), _wide(n[order]))], pa.binary())})

    share = F.pmod(F.xxhash64("code"), F.lit(n_shares)).cast("int")
    return (counts.withColumn("share", share).repartition(n_shares, "share")
            .groupBy("share").applyInArrow(one, "share int, n long, payload binary"))


def start_parameters(unigram: np.ndarray) -> dict[str, np.ndarray]:
    rng, size = np.random.default_rng(1), len(unigram)
    return {"context": rng.normal(0, 0.1, (size, DIM)), "target": rng.normal(0, 0.1, (size, DIM)),
            "far": np.eye(DIM) * 0.5, "near": np.eye(DIM), "bias": np.log(unigram)}


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each of `rows` to the row of `to` that `at` names; names may repeat."""
    order = np.argsort(at, kind="stable")
    named = at[order]
    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    to[named[first]] += np.add.reduceat(rows[order], first, axis=0)


def nce_scores(par: dict, q: np.ndarray, true: np.ndarray, noise: np.ndarray,
               unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds against the noise of the true symbols and of the noise symbols."""
    shift = par["bias"] - np.log(len(noise) * unigram)
    return ((q * par["target"][true]).sum(axis=1) + shift[true], q @ par["target"][noise].T + shift[noise])


def logistic(s: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-s)), in place."""
    np.negative(np.clip(s, -30, 30, out=s), out=s)
    np.exp(s, out=s)
    s += 1
    return np.reciprocal(s, out=s)


def nce_loss(par: dict, far, near, true, weight, noise, unigram) -> float:
    """The weighted mean loss of a batch, whose gradients `nce_gradients` gives."""
    q = par["context"][far] @ par["far"] + par["context"][near] @ par["near"]
    st, sn = nce_scores(par, q, true, noise, unigram)
    return float((weight * (np.logaddexp(0, -st) + np.logaddexp(0, sn).sum(axis=1))).sum() / weight.sum())


def nce_gradients(par: dict, far: np.ndarray, near: np.ndarray, true: np.ndarray, weight: np.ndarray,
                  noise: np.ndarray, unigram: np.ndarray) -> dict:
    """The gradients of a batch of trigrams.

    Each true symbol is told apart from the batch's `noise` symbols, drawn
    from the unigram distribution; the model's scores count as log-probabilities.
    """
    vf, vn = par["context"][far], par["context"][near]
    q = vf @ par["far"] + vn @ par["near"]
    gt, gn = (logistic(s) for s in nce_scores(par, q, true, noise, unigram))
    w = weight / weight.sum()
    gt = (gt - 1) * w
    gn *= w[:, None]
    dq = gt[:, None] * par["target"][true] + gn @ par["target"][noise]
    grad = {k: np.zeros_like(par[k]) for k in ("context", "target", "bias")}
    add_rows(grad["context"], far, dq @ par["far"].T)
    add_rows(grad["context"], near, dq @ par["near"].T)
    add_rows(grad["target"], true, gt[:, None] * q)
    add_rows(grad["target"], noise, gn.T @ q)
    add_rows(grad["bias"], true, gt)
    add_rows(grad["bias"], noise, gn.sum(axis=0))
    return grad | {"far": vf.T @ dq, "near": vn.T @ dq}


def nce_pass(par: dict, code: np.ndarray, n: np.ndarray, unigram: np.ndarray, seed: int, rate: float) -> dict:
    """Parameters after Adagrad steps over every trigram of a share.

    A trigram of more than the mean count comes in several batches, its count
    divided among them; so each counts in full and none fills a batch. A share
    of few batches is passed over again, up to LEAST_STEPS steps.
    """
    par, rng, size = {k: v.astype(np.float32) for k, v in par.items()}, np.random.default_rng(seed), len(unigram)
    sq = {k: np.full_like(v, 1e-6) for k, v in par.items()}
    times = np.ceil(n / n.mean()).astype(np.int64)
    every = np.repeat(np.arange(len(n)), times)
    order = np.concatenate([rng.permutation(every) for _ in range(math.ceil(LEAST_STEPS * BATCH / len(every)))])
    weight, upto, unigram = (n / times).astype(np.float32), np.cumsum(unigram), unigram.astype(np.float32)
    for at in range(0, len(order), BATCH):
        rows = order[at:at + BATCH]
        c = code[rows]
        noise = np.searchsorted(upto, rng.random(NOISE)).clip(max=size - 1)
        grad = nce_gradients(par, c // size ** 2, c // size % size, c % size, weight[rows], noise, unigram)
        for k in par:
            sq[k] += grad[k] ** 2
            par[k] -= rate * grad[k] / np.sqrt(sq[k])
    return par


def train(counts: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS passes over all trigram counts, averaged over the shares.

    Only parameters and the unigram counts of the symbols reach the driver.
    """
    spark = counts.sparkSession
    uni = dict(counts.groupBy((F.col("code") % size).alias("w")).agg(F.sum("n")).collect())
    unigram = np.array([uni.get(i, 0) + 0.5 for i in range(size)], np.float64)
    unigram /= unigram.sum()
    par = start_parameters(unigram)
    if not uni:
        return par | {"bias": np.zeros(size), "target": np.zeros((size, DIM))}
    shares = land(shares_of(counts), "lm-shares")
    total = float(sum(uni.values()))
    names, shapes = list(par), {k: v.shape for k, v in par.items()}
    for nth in range(ROUNDS):
        shared = spark.sparkContext.broadcast(par)

        def run(batches, nth=nth, shared=shared):
            summed = None
            for batch in batches:
                for share, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    code, each = (_narrow(p) for p in B.split_payloads(payload))
                    new = nce_pass(shared.value, code, each, unigram, 1_000_003 * nth + share, RATE / (1 + nth))
                    flat = np.rint(np.concatenate([new[k].ravel() for k in names]) * (n / total * FIXED)).astype(np.int64)
                    summed = flat if summed is None else summed + flat
            if summed is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(summed)), pa.int32()), pa.array(summed)],
                                                 names=["i", "x"])

        mean = shares.mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        flat, at = np.empty(mean.num_rows), 0
        flat[mean.column("i").to_numpy()] = mean.column("x").to_numpy() / FIXED
        for k in names:
            n = int(np.prod(shapes[k]))
            par[k] = flat[at:at + n].reshape(shapes[k])
            at += n
        shared.unpersist()
    return par


class Model:
    """Normalised log10 probabilities of symbols after contexts."""

    def __init__(self, par: dict):
        par = {k: v.astype(np.float32) for k, v in par.items()}
        self.far, self.near = par["context"] @ par["far"], par["context"] @ par["near"]
        self.target, self.bias, self.size = par["target"], par["bias"], len(par["bias"])
        self.contexts, self.norms = np.zeros(0, np.int64), np.zeros(0)

    def logits(self, contexts: np.ndarray) -> np.ndarray:
        """Scores of all symbols after each context."""
        return (self.far[contexts // self.size] + self.near[contexts % self.size]) @ self.target.T + self.bias

    def normalisers(self, contexts: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials after each of the distinct contexts."""
        fresh = np.setdiff1d(contexts, self.contexts, assume_unique=True)
        if len(self.contexts) + len(fresh) > NORM_KEPT:
            self.contexts, self.norms, fresh = self.contexts[:0], self.norms[:0], contexts
        rows, found = max(1, NORM_CELLS // self.size), [self.norms]
        for at in range(0, len(fresh), rows):
            s = self.logits(fresh[at:at + rows])
            top = s.max(axis=1)
            s -= top[:, None]
            found.append(np.log(np.exp(s, out=s).sum(axis=1, dtype=np.float64)) + top)
        every = np.concatenate([self.contexts, fresh])
        order = np.argsort(every)
        self.contexts, self.norms = every[order], np.concatenate(found)[order]
        return self.norms[np.searchsorted(self.contexts, contexts)]

    def log10(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol after its context."""
        out = np.empty(len(symbols))
        for at in range(0, len(symbols), 200_000):
            c, w = contexts[at:at + 200_000], symbols[at:at + 200_000]
            distinct, nth = np.unique(c, return_inverse=True)
            norm = self.normalisers(distinct)
            q = self.far[distinct // self.size] + self.near[distinct % self.size]
            out[at:at + 200_000] = np.einsum("ij,ij->i", q[nth], self.target[w]) + self.bias[w] - norm[nth]
        return out / np.log(10)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `training` is the boolean column of the rows to learn from.
    """
    prepare(docs.sparkSession)
    partitions = shuffle_partitions(docs.sparkSession)
    split = land(B.split_blocks(docs, id_col, text_col, tokens, 4 * partitions, training), "lm-blocks")
    dealt = B.deal(split, partitions)
    counted = land(count_words(dealt, 4 * partitions), "lm-counts")
    corpus = Corpus(counted)
    seqs = land(sequences(counted, dealt, corpus), "lm-sequences")
    par = train(land(trigram_counts(seqs, corpus.size), "lm-counted"), corpus.size)
    shift = float(np.log10(corpus.n + 0.5 * (corpus.distinct + 1)))
    shared, n = docs.sparkSession.sparkContext.broadcast(par), corpus.n

    def run(batches):
        model = Model(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                symbols, = B.unpack(row["symbols"])
                lens = np.array(row["lens"])
                firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                each = model.log10(contexts_of(symbols, lens, model.size), symbols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(lens.astype(np.int64)),
                     pa.array(row["known"], pa.int64()), pa.array(np.full(len(lens), n, np.int64)),
                     pa.array(np.array(row["base"]) - lens * shift),
                     pa.array(np.add.reduceat(each, firsts) + np.array(row["within"]))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return seqs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def op9_neural_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, crc_mod(F.col("doc_id"), 5) != 1)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens",
                        "n_known", "train_tokens", "base_score", "score")
