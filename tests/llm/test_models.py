"""The learned operators: exact parts against brute force, learned parts by held-out accuracy."""

import math
import time
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm import attention_mil, neural_lm, toxicity
from encore.llm.common import crc_mod
from tests.llm.conftest import edge_rows, prose

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def auc(scores, y):
    rank = np.empty(len(y))
    rank[np.argsort(scores, kind="stable")] = np.arange(len(y))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def held_out(spark, found, label):
    rows = found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])


# language model

def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores_equal_brute_force(edge_docs):
    got = neural_lm.score(edge_docs, crc_mod(F.col("doc_id"), 5) != 1).collect()
    train = [tokens(t) for i, t in edge_rows() if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((i is not None, i or 0, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)),
                   round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
                  for i, t in edge_rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6))
                  for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_model_is_normalised_and_uses_context(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 5) for i in range(40)], "doc_id long, text string")
    got = neural_lm.score(docs, F.lit(True)).collect()
    assert got[0].score > got[0].base_score          # the order of words is learned
    model = neural_lm.Model(neural_lm.start_parameters(np.full(40, 1 / 40)))
    for context in (0, 7, 41, 1599):
        each = model.log10(np.full(40, context), np.arange(40))
        assert np.isclose((10.0 ** each).sum(), 1, atol=1e-4)


def test_contexts_stop_at_texts():
    s = np.array([5, 6, 0, 7, 0, 0])
    assert [divmod(int(c), 300) for c in neural_lm.contexts_of(s, [3, 2, 1], 300)] == [
        (0, 0), (0, 5), (5, 6), (0, 0), (0, 7), (0, 0)]


def test_scores_equal_brute_force(edge_docs, monkeypatch):
    """Every token's probability: softmax over all symbols, then the word's part of its class."""
    rng = np.random.default_rng(3)

    def parameters(counts, size):
        return {k: rng.normal(0, 1, shape) for k, shape in (
            ("context", (size, 4)), ("target", (size, 4)), ("far", (4, 4)), ("near", (4, 4)), ("bias", (size,)))}

    kept = []
    monkeypatch.setattr(neural_lm, "train", lambda counts, size: kept.append(parameters(counts, size)) or kept[0])
    got = neural_lm.score(edge_docs, crc_mod(F.col("doc_id"), 5) != 1).collect()
    par = kept[0]
    count = Counter(w for i, t in edge_rows() if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
                    for w in tokens(t))
    words = sorted((w for w in count if w), key=lambda w: (-count[w], w))
    own = {w: 33 + i for i, w in enumerate(words[:math.ceil(math.sqrt(len(words)))])}
    assert len(par["bias"]) == 33 + len(own) and len(own) > 8
    mass = Counter()
    for w in words:
        if w not in own:
            mass[neural_lm.shape(w)] += count[w] + 0.5

    def symbol(w):
        return own[w] if w in own else 1 + neural_lm.shape(w) if w else 0

    def brute(text):
        far = near = 0
        total = 0.0
        for w in tokens(text):
            s = symbol(w)
            logits = (par["context"][far] @ par["far"] + par["context"][near] @ par["near"]) @ par["target"].T + par["bias"]
            total += (logits[s] - np.log(np.exp(logits).sum())) / np.log(10)
            if w and w not in own:
                total += math.log10((count[w] + 0.5) / (mass[neural_lm.shape(w)] + 0.5))
            far, near = near, s
        return total

    mine = sorted(r.score for r in got)
    assert np.allclose(mine, sorted(brute(t) for _, t in edge_rows()), rtol=1e-4)


def test_language_model_grows_and_ignores_layout(spark):
    """More distinct words give more symbols and trigrams; files and partitions change nothing."""
    assert [neural_lm.n_words(n) for n in (0, 1, 100, 1_000_000)] == [0, 1, 10, 1000]
    counts = spark.range(3000).select((F.col("id") * 37 % 64000).alias("code"), (F.col("id") % 7 + 1).alias("n"))
    monkey = neural_lm.SHARE_ROWS
    neural_lm.SHARE_ROWS = 1000
    try:
        one, many = neural_lm.train(counts.coalesce(1), 40), neural_lm.train(counts.repartition(7), 40)
        shares = neural_lm.shares_of(counts).collect()
    finally:
        neural_lm.SHARE_ROWS = monkey
    assert len(shares) == 3 and sum(r.n for r in shares) == counts.agg(F.sum("n")).first()[0]
    assert all(np.array_equal(one[k], many[k]) for k in one)


def test_noise_contrastive_gradients_by_difference():
    rng = np.random.default_rng(5)
    size, unigram = 12, np.full(12, 1 / 12)
    par = neural_lm.start_parameters(unigram)
    far, near, true = rng.integers(0, size, (3, 20))
    weight, noise = rng.random(20) + 0.1, rng.integers(0, size, 30)
    grad = neural_lm.nce_gradients(par, far, near, true, weight, noise, unigram)
    for k in par:
        at = tuple(rng.integers(0, d) for d in par[k].shape)
        ends = []
        for step in (1e-5, -1e-5):
            moved = {n: v.copy() for n, v in par.items()}
            moved[k][at] += step
            ends.append(neural_lm.nce_loss(moved, far, near, true, weight, noise, unigram))
        assert np.isclose((ends[0] - ends[1]) / 2e-5, grad[k][at], rtol=1e-4, atol=1e-8), k


def test_model_beats_counts_on_held_out_texts(spark):
    """The order of words in one half of the texts is learned from the other half."""
    rng = np.random.default_rng(9)
    nouns, verbs = [f"noun{i}" for i in range(12)], [f"verb{i}" for i in range(12)]
    rows = [(i, " ".join(f"the {nouns[a]} {verbs[b]} a" for a, b in rng.integers(0, 12, (30, 2)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neural_lm.score(docs, F.col("doc_id") < 100).where("doc_id >= 100").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_language_model_edge_tables(no_docs, edge_docs):
    assert neural_lm.score(no_docs, F.lit(True)).count() == 0
    got = neural_lm.score(edge_docs, F.lit(False)).collect()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}
    assert all(abs(r.base_score) < 1e-9 for r in got)  # each token has all of the mass


# quality

def test_quality_edge_rows(edge_docs, no_docs, labels):
    par = attention_mil.fit(edge_docs, labels, F.lit(True))
    got = attention_mil.score(edge_docs, par).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id == 8][0] == [r.score for r in got if r.doc_id == 8][1]
    assert attention_mil.score(no_docs, par).count() == 0
    none = attention_mil.fit(no_docs, labels.where("false"), F.lit(True))
    assert {r.score for r in attention_mil.score(edge_docs, none).collect()} == {0.5}
    carried = attention_mil.score(edge_docs.drop("score"), none, carry=["text", "doc_id"])
    assert carried.columns == ["text", "doc_id", "score", "n_passages", "top_passage"]


def test_passages_are_whole_texts():
    x, bags = attention_mil.encode([prose(1, 200), "", None, "one"])
    assert bags.tolist() == [4, 1, 1, 1] and len(x) == 7
    alone, _ = attention_mil.encode([prose(1, 200)])
    assert np.allclose(x[:4], alone)


def test_gradient_by_difference():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(30, 5)), np.array([4, 6, 10, 10]), np.array([0.0, 1.0, 1.0, 0.0])
    par = attention_mil.train(x, bags, y)
    score, att, _ = attention_mil.forward(par, x, bags)
    assert np.abs(score - y).max() < 0.2
    assert np.allclose(np.add.reduceat(att, np.cumsum(bags) - bags), 1)


@needs_data
def test_quality_held_out(spark):
    score, y, predicted = held_out(spark, attention_mil.op3_attention_mil(spark, SF), "quality")
    assert auc(score, y) > 0.97 and (predicted == y).mean() > 0.97


# toxicity

def test_deobfuscation():
    words = "idiot stupid loser moron there three other letter hotel still title radio round cloud".split() * 20
    total = Counter(f"^^{w}$"[i:i + 3] for w in words for i in range(len(w) + 1))
    pairs = Counter()
    for g, n in total.items():
        pairs[g[:2]] += n
    decoder = toxicity.Decoder({g: math.log((n + 0.1) / (pairs[g[:2]] + 5)) for g, n in total.items()})
    for shown, word in {"1d10t": "idiot", "!d!ot": "idiot", "5tup1d": "stupid", "stuuuupid": "stupid",
                        "i.d.i.o.t": "idiot", "l0s3r": "loser", "m0r0n!!": "moron", "st-up-id": "stupid"}.items():
        assert word in decoder.forms(shown), shown
    assert decoder.spaced("the i d i o t is".split()) == ["idiot"]
    assert decoder.forms("letter,") == ("letter",)


def test_learns_disguised_words(spark, tmp_path):
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, prose(i, 40) + (" blarg" if bad else "") + " " + prose(i + 1000, 30), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", docs.y.alias("toxic"))
    model = toxicity.fit(docs, labels, F.lit(True))
    assert "blarg" in model["lexicon"]
    new = [(1, prose(999, 50)), (2, prose(999, 50) + " BLARG"), (3, "a bl4rg b l a r g"), (4, None), (5, ""), (5, ""),
           (None, "blaaaarg and b.l.a.r.g")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert min(got[2], got[3], got[None]) >= 0.7 > 0.3 > max(got[1], got[4], got[5])


def test_word_boundaries_in_runs(spark):
    common = "a i the stupid idiot student strong loser grass ready as total round cloud pilot is an and so".split()
    docs = spark.createDataFrame([(i, " ".join(common)) for i in range(20)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.train_trigrams(docs))
    assert "stupid" in decoder.spaced("you a s t u p i d are".split())
    assert {"stupid", "idiot"} <= set(decoder.spaced("s t u p i d i d i o t".split()))
    assert "stupid" in decoder.spaced("a 5 t u p 1 d".split())
    assert "ass" not in decoder.spaced("g r a s s".split())
    model = {"trigrams": decoder.trigrams, "lexicon": {"stupid": 0.9, "idiot": 0.9}, "base": 0.05}
    texts = ["a s t u p i d", "stu pid", "you 5tu p1d one", "s t u p i d i d i o t", "the student is", "stu dent"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.evidence for r in toxicity.score(rows, model).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 0, 5: 0}


def test_long_runs_and_tokens_are_linear():
    words = "stupid idiot alpha radio round cloud".split() * 20
    total = Counter(f"^^{w}$"[i:i + 3] for w in words for i in range(len(w) + 1))
    decoder = toxicity.Decoder({g: math.log(n / 1000) for g, n in total.items()})
    start = time.monotonic()
    decoder.spaced(["|"] * 100_000)
    decoder.spaced(["a"] * 100_000)
    decoder.spaced(["a", "b"] * 3000)
    decoder.forms("a1b2c3" * 30_000)
    decoder.forms("x" * 1_000_000)
    assert time.monotonic() - start < 30
    assert set(decoder.forms("stu" + "p" * 100_000 + "id")) == {"stupid", "stu" + "p" * 100_000 + "id"}
    assert "idiot" in decoder.spaced([*"idi" + "o" * 5000 + "t"])


def test_only_copies_are_grouped(spark):
    """Texts that share frequent words all stay; of exact and near copies with one label the first stays."""
    own = [(i, prose(i, 60), int(i % 4 == 0)) for i in range(60)]
    near = [(100 + i, prose(1, 60) + f" end{i}", 0) for i in range(20)]
    docs = spark.createDataFrame([*own, *near, (200, " " + prose(2, 60).upper(), 0), (201, prose(4, 60), 0),
                                  (202, "", 0), (203, " ", 0)], "doc_id long, text string, toxic int")
    got = toxicity.sample_rows(docs, docs.select("doc_id", "toxic"), F.lit(True), "doc_id", "text", "toxic", 1000)
    want = [(t, y) for _, t, y in own] + [(prose(4, 60), 0), ("", 0)]
    assert sorted((r.text, r.y) for r in got.collect()) == sorted(want)


def test_character_model_of_all_documents(spark):
    """Trigrams come from all rows, labelled or not; rare ones are kept too."""
    docs = spark.createDataFrame([(i, "alpha, beta beta 4lpha", None) for i in range(50)] + [(99, "ünï xyz", 1)],
                                 "doc_id long, text string, toxic int")
    got = toxicity.fit(docs, docs.select("doc_id", "toxic").where("false"), F.lit(True))["trigrams"]
    n = {"^^a": 50, "^^b": 100, "^^x": 1, "^^ü": 1}
    assert {g for g in got if g.startswith("^^")} == set(n)
    assert all(math.isclose(got[g], math.log((n[g] + 0.1) / (152 + 5))) for g in n)
    assert "ünï" in got and "lph" in got


def test_toxicity_edge_tables(edge_docs, no_docs, labels):
    model = toxicity.fit(edge_docs, labels, F.lit(True))
    got = toxicity.score(edge_docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(no_docs, labels.where("false"), F.lit(True))
    assert toxicity.score(no_docs, none).count() == 0


@needs_data
def test_toxicity_held_out(spark):
    score, y, predicted = held_out(spark, toxicity.op2_toxicity(spark, SF), "toxic")
    assert auc(score, y) > 0.9 and (predicted == y).mean() > 0.95
