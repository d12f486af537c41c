"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (windows of words). Every passage is encoded
by measurements of its words and a small tanh layer; gated attention weighs
the passages, and the weighted representation gives the document's score.
Only documents carry labels; the weights of the passages are learned from
them. Training is numpy on a bounded sample of labelled rows; scoring is a
map over all documents and all their passages.

Null and empty texts are a bag of one empty passage and get a score like any
other. Every input row gives one output row (repeated rows and null ids
too). A document with several labels counts with the lowest; null labels are
not learned from. Without labelled rows of both classes every score is 0.5.
Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.blocks import Numbering, _numbers
from encore.llm.common import SMALL_BATCH, crc_mod, prepare, table

PASSAGE_WORDS = 64
MAX_LABELLED = 6_000        # labelled rows learned from: those of the least id hash
MAX_BAG = 200               # passages of a document that is learned from; longer ones are scored only
HIDDEN, GATE, EPOCHS, RATE, DECAY = 16, 8, 300, 0.02, 1e-4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

# class of a byte: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 heavy symbol, 5 light punctuation, 6 not ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[list(b"#*$%&|<>@~^_=+{}[]\\/")] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
N_CLASSES = 7
FEATURES = N_CLASSES + 9


def _word_table(words: list[bytes]) -> np.ndarray:
    """Per distinct word: bytes by class, then flags (all capitals, has symbol, ends in '!')."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    of = np.repeat(np.arange(len(words)), lens)
    counts = np.bincount(of * N_CLASSES + _CLASS[raw], minlength=len(words) * N_CLASSES) \
        .reshape(-1, N_CLASSES).astype(np.float32)
    bang = np.bincount(of[raw == 33], minlength=len(words))
    return np.column_stack([counts, (counts[:, 2] > 1) & (counts[:, 1] == 0), counts[:, 4] > 0,
                            bang > 1, lens]).astype(np.float32)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of the passages of all texts, and the number of passages of each text."""
    numbering, seqs = Numbering(), []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split() if len(raw) < 4_000_000 else (m.group() for m in WORD.finditer(raw))
        seqs.append(_numbers(numbering, words))
    sizes = np.array([len(s) for s in seqs], np.int64)
    bags = np.maximum(1, -(-sizes // PASSAGE_WORDS))
    out = np.zeros((int(bags.sum()), FEATURES), np.float32)
    firsts = np.cumsum(bags) - bags
    if not sizes.sum():
        return out, bags
    ids = np.concatenate(seqs).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = firsts[doc] + place // PASSAGE_WORDS
    n = np.bincount(passage, minlength=len(out)).astype(np.float32)
    per = _word_table(list(numbering))
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    sums = np.zeros((len(out), per.shape[1]), np.float32)
    sums[passage[starts]] = np.add.reduceat(per[ids], starts, axis=0)
    some = np.maximum(n, 1)
    size = np.maximum(sums[:, -1], 1)
    out[:, :N_CLASSES] = sums[:, :N_CLASSES] / size[:, None]
    out[:, N_CLASSES:N_CLASSES + 3] = sums[:, N_CLASSES:N_CLASSES + 3] / some[:, None]
    out[:, N_CLASSES + 3] = sums[:, -1] / some / 8
    # words that are new in their passage, that repeat the one before, three-word windows seen before
    distinct = np.unique(passage * len(numbering) + ids)
    out[:, N_CLASSES + 4] = np.bincount(distinct // len(numbering), minlength=len(out)) / some
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    out[:, N_CLASSES + 5] = np.bincount(passage[again], minlength=len(out)) / some
    if len(ids) > 2:
        a, b, c, d = (x.astype(np.uint64) for x in (ids[:-2], ids[1:-1], ids[2:], doc[:-2]))
        code = ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) + c) \
            * np.uint64(0x165667B19E3779F9) + d * np.uint64(0x27D4EB2F165667C5)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, first = np.unique(code[inside], return_index=True)
        seen = np.ones(len(inside), bool)
        seen[first] = False
        out[:, N_CLASSES + 6] = np.bincount(passage[inside[seen]], minlength=len(out)) / some
    out[:, N_CLASSES + 7] = np.log1p(n) / 4
    out[:, N_CLASSES + 8] = np.repeat(np.log1p(sizes), bags) / 8
    return out, bags


def forward(par: dict, x: np.ndarray, bags: np.ndarray):
    """Scores of the bags, attention of the passages, and what the gradient needs."""
    firsts = np.cumsum(bags) - bags
    h = np.tanh((x - par["mean"]) / par["std"] @ par["W"] + par["w0"])
    v, u = np.tanh(h @ par["V"]), 1 / (1 + np.exp(-(h @ par["U"])))
    e = (v * u) @ par["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), bags))
    att = e / np.repeat(np.add.reduceat(e, firsts), bags)
    z = np.add.reduceat(att[:, None] * h, firsts, axis=0)
    score = 1 / (1 + np.exp(-(z @ par["c"] + par["c0"]).clip(-30, 30)))
    return score, att, (h, v, u, z)


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict:
    """Adam on the log-loss; both classes weigh the same half."""
    rng, d = np.random.default_rng(3), x.shape[1]
    fixed = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-3}
    par = {"W": rng.normal(0, d ** -0.5, (d, HIDDEN)), "w0": np.zeros(HIDDEN),
           "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
           "a": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN),
           "c0": np.zeros(1)}
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    xs = (x - fixed["mean"]) / fixed["std"]
    m, s = ({k: np.zeros_like(p) for k, p in par.items()} for _ in range(2))
    for t in range(1, EPOCHS + 1):
        score, att, (h, v, u, z) = forward(par | fixed, x, bags)
        g = weight * (score - y)
        dz = np.repeat(g[:, None] * par["c"], bags, axis=0)
        datt = (dz * h).sum(axis=1)
        firsts = np.cumsum(bags) - bags
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, firsts), bags))
        dvu = de[:, None] * par["a"]
        dv, du = dvu * u * (1 - v ** 2), dvu * v * u * (1 - u)
        dh = (att[:, None] * dz + dv @ par["V"].T + du @ par["U"].T) * (1 - h ** 2)
        grad = {"W": xs.T @ dh, "w0": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du,
                "a": (v * u).T @ de, "c": z.T @ g, "c0": np.array([g.sum()])}
        for k in par:
            grad[k] = grad[k] + DECAY * par[k]
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
            par[k] = par[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
    return par | fixed


def labelled_rows(labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """At most `limit` (doc_id, y): the labelled rows of the least id hash."""
    return (labels.where(usable & F.col(label).isNotNull()).groupBy("doc_id")
            .agg(F.min(label).cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id",
        text_col: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> dict:
    """Parameters learned from at most `max_labelled` documents of at most MAX_BAG passages."""
    prepare(docs.sparkSession, SMALL_BATCH)
    sample = F.broadcast(labelled_rows(labels, label, usable, max_labelled))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .join(sample, "doc_id").select("text", "y")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                x, bags = encode(part.column(0).to_pylist())
                ends = np.cumsum(bags)
                keep = [i for i, n in enumerate(bags) if n <= MAX_BAG]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[ends[i] - bags[i]:ends[i]].tobytes() for i in keep], pa.binary()),
                     pa.array([part.column(1)[i].as_py() for i in keep], pa.int32())], names=["x", "y"])

    rows = sorted((bytes(r.x), r.y) for r in texts.mapInArrow(run, "x binary, y int").collect())
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return {"share": 0.5}
    bags = np.array([len(r[0]) // (4 * FEATURES) for r in rows])
    x = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return train(x, bags, y)


def score(docs: DataFrame, par: dict, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """(doc_id, score, n_passages, top_passage) of every row; top_passage has the most attention.

    With `carry`, these columns of `docs` stand in the place of doc_id.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    shared = docs.sparkSession.sparkContext.broadcast(par)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id")) if carry is None else docs.select(carry)
    source = docs.select(F.col(text_col).alias("_text"), *(
        [F.col(id_col).cast("long").alias("doc_id")] if carry is None else [F.col(f"`{c}`") for c in carry]))
    names = [*kept.columns, "score", "n_passages", "top_passage"]

    def run(batches):
        par = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                x, bags = encode(part.column(0).to_pylist())
                firsts = np.cumsum(bags) - bags
                if "share" in par:
                    got, top = np.full(len(bags), par["share"]), np.zeros(len(bags), np.int64)
                else:
                    got, att, _ = forward(par, x, bags)
                    best = np.lexsort((np.arange(len(att)), -att, np.repeat(np.arange(len(bags)), bags)))
                    top = best[firsts] - firsts
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(got), pa.array(bags), pa.array(top)], names=names)

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return source.mapInArrow(run, f"{fields}, score double, n_passages long, top_passage long")


def op3_attention_mil(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    par = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return score(docs, par).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_passages", "top_passage")
