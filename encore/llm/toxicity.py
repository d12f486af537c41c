"""Toxicity by noisy-channel deobfuscation.

A token that may be disguised (symbols or digits between letters, letters
three times in a row, letters standing alone one after another) is a lattice:
every character may stand for itself, for a letter it looks like, for nothing
(a separator) or for a repetition of the letter before. In a run of lone
letters a word may end anywhere, and the words of all divisions near the best
are taken. Tokens in a row that together spell a word of the lexicon count as
it if the model prices them lower as one word. The Viterbi decoder takes the path that is best under the channel's costs and a character trigram
model, which is trained on the plain words of all documents. Restored
words and their beginnings are then looked up in a lexicon of weights learned
from labels, and a document's score joins the evidence by noisy-or.

Training reads a bounded sample of labelled rows (those of the least id
hash), one of each group of copies with the same label (the same words, or a
Jaccard index of word shingles of 0.8 and more), so that one text copied many
times is not many witnesses. A lexicon entry must stand out from the share of toxic
documents by more than chance explains among all candidates.

Null and empty texts have no evidence and get the score of documents without
any. Every input row gives one output row (repeated rows and null ids too).
A document with several labels counts with the lowest; null labels are not
learned from. Without toxic labelled rows every score is the smoothed share.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.attention_mil import labelled_rows
from encore.llm.common import crc_mod, land, prepare, table

MAX_LABELLED = 20_000       # labelled rows learned from
MAX_LEXICON = 50_000        # lexicon entries, those of most evidence
LEAST_SHARE = 1e-7          # of all trigrams of the corpus, for one to be in the character model
MAX_CACHE = 300_000         # words remembered in a task
PREFIXES = (4, 5, 6)        # beginnings that count as features beside the whole word
LEAST_ROWS = 3              # toxic rows that a candidate for the lexicon occurs in
CHANCE = 0.5                # expected number of lexicon entries by chance alone
SHINGLE, BANDS, BAND_ROWS = 3, 16, 4    # words of a shingle; MinHash values by band
LEAST_JACCARD = 0.8         # of the shingles of near copies

# The letters a character may stand for in leetspeak.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
COST_LOOKS, COST_SEPARATOR, COST_REPEAT = 1.0, 0.4, 4.0
MARGIN = 4.0                # cost over the best division of a run at which its words are still looked up
EDGES = ".,;:!?\"'()[]{}…«»“”‘’#*%&$|<>-_~^=+/\\@`"
TRIPLE = re.compile(r"([^\W\d_])\1\1")
REPEATED = re.compile(r"(.)\1{4,}", re.DOTALL)
REPEATS_READ = 4            # of one character in a row; further ones say nothing more
LONGEST_IN_RUN = 64         # characters of a run that one word may span


def step(states: dict, ch: str, trigrams: dict[str, float], floor: float) -> dict:
    """The states (last two letters -> cost, letters so far) after one more character.

    Letters are a chain of pairs (letters before, letter), so that a step
    costs the same at any place of a long token.
    """
    after: dict[tuple[str, str], tuple[float, tuple | None]] = {}

    def reach(state, cost, letters):
        if state not in after or cost < after[state][0]:
            after[state] = (cost, letters)

    read = [(c, COST_LOOKS) for c in LOOKS_LIKE.get(ch, "")]
    if ch.isalpha():
        read.append((ch, 0.0))
    for (a, b), (cost, letters) in states.items():
        for c, price in read:
            reach((b, c), cost + price - trigrams.get(a + b + c, floor), (letters, c))
        if not ch.isalnum():
            reach((a, b), cost + COST_SEPARATOR, letters)
        if ch == b or (b != "^" and b in LOOKS_LIKE.get(ch, "")):
            reach((a, b), cost + COST_REPEAT, letters)
    return after


def ended(states: dict, trigrams: dict[str, float], floor: float) -> tuple[float, tuple | None]:
    """The cost and letters of the best word that ends here; of equal ones that of the least state."""
    cost, best = min((cost - trigrams.get(a + b + "$", floor), (a, b)) for (a, b), (cost, _) in states.items())
    return cost, states[best][1]


def spelled(letters: tuple | None) -> str:
    out = []
    while letters is not None:
        letters, c = letters
        out.append(c)
    return "".join(reversed(out))


def read_once(token: str) -> str:
    """The token with runs of one character cut to REPEATS_READ."""
    return REPEATED.sub(lambda m: m.group(1) * REPEATS_READ, token)


def viterbi(token: str, trigrams: dict[str, float], floor: float) -> str:
    """The most probable letters behind `token`; '' if it can stand for none."""
    return priced(token, trigrams, floor)[1]


def priced(token: str, trigrams: dict[str, float], floor: float) -> tuple[float, str]:
    """The most probable letters behind `token` and their cost; '' if it can stand for none."""
    states: dict = {("^", "^"): (0.0, None)}
    for ch in read_once(token):
        states = step(states, ch, trigrams, floor)
        if not states:
            return math.inf, ""                      # a digit that looks like no letter
    cost, letters = ended(states, trigrams, floor)
    return cost, spelled(letters)


def words_in_run(run: str, trigrams: dict[str, float], floor: float) -> set[str]:
    """Words of the divisions of `run` that cost at most MARGIN more than the best one.

    A boundary may stand between any two characters. The forward pass has the
    best cost of every state and boundary; the words from a boundary are
    followed while their states are within MARGIN of it, over LONGEST_IN_RUN
    characters at most. So the work grows with the length of the run.
    """
    run, start = read_once(run), ("^", "^")
    best: list[dict] = [{start: 0.0}]                # per place: state -> least cost
    states: dict = {start: (0.0, None)}
    for ch in run:
        states = step(states, ch, trigrams, floor)
        end = ended(states, trigrams, floor)[0]
        if start not in states or end < states[start][0]:
            states[start] = (end, None)
        # letters are not needed here; without them a step costs the same at any place
        states = {k: (cost, None) for k, (cost, _) in states.items()}
        best.append({k: cost for k, (cost, _) in states.items()})
    rest = [math.inf] * len(run) + [0.0]             # least cost from a boundary to the end
    words: list[tuple[int, float, tuple | None]] = []
    for i in range(len(run) - 1, -1, -1):
        before = best[i][start]
        states = {start: (before, None)}
        for j in range(i + 1, min(len(run), i + LONGEST_IN_RUN) + 1):
            states = {k: v for k, v in step(states, run[j - 1], trigrams, floor).items()
                      if v[0] <= best[j].get(k, math.inf) + MARGIN}
            if not states:
                break
            cost, letters = ended(states, trigrams, floor)
            if cost <= best[j][start] + MARGIN:
                words.append((j, cost, letters))
                rest[i] = min(rest[i], cost - before + rest[j])
    limit = best[-1][start] + MARGIN
    return {w for j, cost, letters in words if cost + rest[j] <= limit and len(w := spelled(letters)) > 1}


def candidates(word: str) -> list[str]:
    """Forms of a lower-case token that need decoding; none for a plain word."""
    core = word.strip(EDGES)
    out = []
    if TRIPLE.search(core) if core.isalpha() else any(c.isalpha() for c in core):
        out.append(core)
    if word[:1] in LOOKS_LIKE and word[1:2].isalpha():  # a look-alike in front of the letters
        out.append(word.rstrip(EDGES))
    return out


def features_of(word: str) -> list[str]:
    if len(word) < 3:
        return []
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def squeezed(word: str) -> str:
    """The word with runs of a letter as one: a restored run may have lost a doubled letter."""
    return re.sub(r"(.)\1+", r"\1", word)


class Lookup:
    """Whole words of a lexicon that tokens in pieces may spell, and their proper beginnings."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {f for f in lexicon if "~" not in f and len(f) >= 4}
        self.beginnings = {f[:n] for f in self.words for n in range(1, len(f))}
        self.longest = max(map(len, self.words), default=0)  # every token adds a letter at least


class Decoder:
    """Forms of the words of a text: as written without edges, and restored."""

    def __init__(self, trigrams: dict[str, float]):
        self.trigrams, self.floor = trigrams, min(trigrams.values(), default=-8.0) - 2.0
        self.known: dict[str, tuple[str, ...]] = {}

    def forms(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            if word.isalpha() and not TRIPLE.search(word):
                got = (word,)
            else:
                restored = [viterbi(c, self.trigrams, self.floor) for c in candidates(word)]
                got = tuple({x for x in (word.strip(EDGES), *restored) if x})
            if len(self.known) >= MAX_CACHE:
                self.known.clear()
            self.known[word] = got
        return got

    def lone(self, word: str) -> str:
        """The character that the word consists of, if it may stand for a letter; else ''."""
        # a word between letters is itself without edges
        c = word if word[0] not in EDGES and word[-1] not in EDGES else word.strip(EDGES) or word
        return c if len(c) == 1 and (c.isalpha() or c in LOOKS_LIKE) else ""

    def spaced(self, words: list[str], lone: dict[str, str] | None = None) -> list[str]:
        """Restored words of runs of three and more lone characters (`lone`: those among the words)."""
        if lone is None:
            lone = {w: c for w in set(words) if (c := self.lone(w))}
        out, run = set(), []
        for w in [*words, ""] if lone else []:
            if w in lone:
                run.append(lone[w])
            elif run:
                if len(run) >= 3:
                    out |= words_in_run("".join(run), self.trigrams, self.floor)
                run = []
        return sorted(out)

    def beginnings(self, word: str, wanted: "Lookup") -> tuple[str, ...]:
        """Forms of the word with which a longer word of the lookup begins."""
        return tuple(f for f in self.forms(word) if f in wanted.beginnings)

    def pieces(self, words: list[str], wanted: "Lookup", starts: dict[str, tuple[str, ...]] | None = None) -> set[str]:
        """Words of the lookup that several tokens in a row spell, where the model prices them lower as one word.

        `starts` are the words that have `beginnings`.
        """
        if starts is None:
            starts = {w: b for w in set(words) if (b := self.beginnings(w, wanted))}
        out = set()
        for i, first in enumerate(words if starts else []):
            for form in starts.get(first, ()):
                tokens, states = [first], {form}
                for w in words[i + 1:i + 1 + wanted.longest]:
                    tokens.append(w)
                    states = {a + f for a in states for f in self.forms(w)}
                    for word in states & wanted.words:
                        if self.is_one(word, tokens):
                            out.add(word)
                    states &= wanted.beginnings
                    if not states:
                        break
        return out

    def is_one(self, word: str, tokens: list[str]) -> bool:
        # the joined word pays a separator for every gap, the divided tokens pay their ends
        cores = [w.strip(EDGES) or w for w in tokens]
        apart = sum(priced(c, self.trigrams, self.floor)[0] for c in cores)
        joined = priced("".join(cores), self.trigrams, self.floor)[0] + COST_SEPARATOR * (len(tokens) - 1)
        return joined < apart

    def all_forms(self, text: str) -> set[str]:
        words = text.lower().split()
        found = {f for w in set(words) for f in self.forms(w)}
        return found.union(self.spaced(words))


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the runs of SHINGLE words; a shorter text is one run."""
    words = text.lower().split()
    runs = [" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands of BAND_ROWS MinHash values each."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 10_000):
        x = hashes[at:at + 10_000, None] * odd + add
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[i:i + BAND_ROWS].tobytes(), i) - (1 << 63)
            for i in range(0, len(least), BAND_ROWS)]


def one_of_copies(rows: DataFrame) -> DataFrame:
    """(text, y) of `rows` (doc_id, text, y), one of each group of copies with the same label.

    Exact copies have the same words in the same order. Rows that share a band
    of MinHash values are compared with the first row of the band only, so a
    group of copies costs no more than its size; a row goes if its shingles
    and those of an earlier row have a Jaccard index of LEAST_JACCARD or more.
    """
    words = F.array_join(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), " ")
    exact = rows.groupBy("y", F.sha2(words.cast("binary"), 256).alias("copy")) \
        .agg(F.min(F.struct("doc_id", "text")).alias("r"))
    rows = land(exact.select("y", F.struct("r.doc_id", "copy").alias("place"), "r.text"), "toxicity-distinct")

    def keys(batches):
        for batch in batches:
            ids, copies, ys, texts = (c.to_pylist() for c in batch.columns)
            each = [bands(shingles(t)) for t in texts]
            n = np.full(len(each), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.repeat(np.array(copies, object), n)),
                 pa.array(np.repeat(np.array(ys, np.int32), n)), pa.array([k for e in each for k in e], pa.int64())],
                names=["doc_id", "copy", "y", "band"])

    def close(batches):
        for batch in batches:
            ids, copies, mine, theirs = (c.to_pylist() for c in batch.columns)
            near = []
            for a, b in zip(mine, theirs):
                x, y = shingles(a), shingles(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= LEAST_JACCARD * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, ok in zip(ids, near) if ok], pa.int64()),
                                              pa.array([c for c, ok in zip(copies, near) if ok], pa.string())],
                                             names=["doc_id", "copy"])

    banded = rows.select(F.col("place.doc_id").cast("long").alias("doc_id"), "place.copy", "y", "text") \
        .mapInArrow(keys, "doc_id long, copy string, y int, band long") \
        .select(F.struct("doc_id", "copy").alias("place"), "y", "band")
    banded = land(banded, "toxicity-bands")
    first = banded.groupBy("y", "band").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(first, ["y", "band"]).where("place != first").select("y", "place", "first").distinct()
    # exact copies with different labels have the same place, so the label is part of the key
    at = rows.select(F.struct(F.col("place.doc_id").cast("long").alias("doc_id"), "place.copy").alias("place"),
                     "y", "text")
    texts = pairs.join(at, ["y", "place"]).join(
        at.select("y", F.col("place").alias("first"), F.col("text").alias("other")), ["y", "first"])

    def labelled(y):
        return texts.where(F.col("y") == y).select("place.doc_id", "place.copy", "text", "other") \
            .mapInArrow(close, "doc_id long, copy string").distinct() \
            .select(F.struct("doc_id", "copy").alias("place"), F.lit(y).alias("y"))

    return at.join(labelled(0).union(labelled(1)), ["y", "place"], "left_anti").select("text", "y")


def sample_rows(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str,
                label: str, limit: int) -> DataFrame:
    """(text, y) of the labelled sample, one row of each group of copies."""
    chosen = F.broadcast(labelled_rows(labels, label, usable, limit))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(chosen, "doc_id")
    return one_of_copies(land(rows, "toxicity-sample"))


def train_trigrams(docs: DataFrame) -> dict[str, float]:
    """Natural log probabilities of a letter after two, from the plain words of all texts.

    Words are counted first, then their trigrams, in tasks and in a shuffle.
    Trigrams of less than LEAST_SHARE of all are left out; the sums that the
    probabilities refer to keep them.
    """
    def run(batches):
        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words.update((text.as_py() or "").lower().split())
                if len(words) >= MAX_CACHE:
                    yield of_words(words)
                    words = Counter()
        yield of_words(words)

    def of_words(words):
        total: dict[str, int] = {}
        for w, n in words.items():
            w = w.strip(EDGES)
            if w.isalpha() and not TRIPLE.search(w):
                s = f"^^{w}$"
                for i in range(len(s) - 2):
                    g = s[i:i + 3]
                    total[g] = total.get(g, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                           pa.array(list(total.values()), pa.int64())], names=["g", "n"])

    counts = land(docs.select("text").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")),
                  "toxicity-trigrams")
    n_all = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= n_all * LEAST_SHARE).withColumn("pair", F.substring("g", 1, 2))
    pairs = counts.groupBy(F.substring("g", 1, 2).alias("pair")).agg(F.sum("n").alias("n_pair"))
    rows = kept.join(pairs, "pair").select("g", "n", "n_pair").collect()
    return {g: math.log((n + 0.1) / (m + 5.0)) for g, n, m in rows}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id",
        text_col: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict:
    """The model: trigrams, lexicon and the score without evidence, all of bounded size."""
    spark = docs.sparkSession
    prepare(spark)
    rows = land(sample_rows(docs, labels, usable, id_col, text_col, label, max_labelled), "toxicity-rows")
    n_all, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (n_toxic + 0.5) / (n_all + 1)
    trigrams = train_trigrams(docs.select(F.col(text_col).alias("text")))
    shared = spark.sparkContext.broadcast(trigrams)

    def counted(wanted=None):
        def run(batches):
            decoder, total = Decoder(shared.value), {}
            for batch in batches:
                for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for f in {f for w in decoder.all_forms(text) for f in features_of(w)}:
                        if wanted is None or f in wanted.value:
                            n, t = total.get(f, (0, 0))
                            total[f] = (n + 1, t + y)
            got = list(total.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in got], pa.string()), pa.array([v[0] for _, v in got], pa.int64()),
                 pa.array([v[1] for _, v in got], pa.int64())], names=["f", "n", "t"])
        return run

    # candidates come from the toxic rows, then all rows are counted for them alone
    toxic = rows.where("y = 1").mapInArrow(counted(), "f string, n long, t long")
    toxic = land(toxic.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS),
                 "toxicity-candidates")
    n_features = max(1, toxic.count())
    least = math.log(n_features / CHANCE) / -math.log(share)
    wanted = {r.f for r in toxic.where(F.col("n") >= least).orderBy(F.desc("n"), "f").limit(MAX_LEXICON).collect()}
    lexicon = {}
    if wanted:
        seen = (rows.mapInArrow(counted(spark.sparkContext.broadcast(wanted)), "f string, n long, t long")
                .groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect())
        for f, n, t in seen:
            p = (t + 2 * share) / (n + 2)
            q = min(t / n, 1 - 1e-9)
            gain = n * (q * math.log(q / share) + (1 - q) * math.log((1 - q) / (1 - share)))
            if p >= 0.5 and gain >= math.log(n_features / CHANCE):
                lexicon[f] = p
    model = {"trigrams": trigrams, "lexicon": lexicon, "base": share}
    model["base"] = _base(rows, model, share)
    return model


def _base(rows: DataFrame, model: dict, share: float) -> float:
    """The smoothed share of toxic documents among those without evidence."""
    found = score(rows.select(F.col("y").cast("long").alias("doc_id"), "text"), model | {"base": 0.0})
    n, t = found.where("evidence = 0").agg(F.count("*"), F.coalesce(F.sum("doc_id"), F.lit(0))).first()
    return (t + 2 * share) / (n + 2)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) of every row; evidence counts its words in the lexicon."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, known = shared.value, {}
        decoder, lexicon = Decoder(model["trigrams"]), model["lexicon"]
        whole = Lookup(lexicon)
        short = {squeezed(f): p for f, p in sorted(lexicon.items()) if "~" not in f and len(f) >= 5}
        # what an entry's first letters are decides for most words that they have none
        heads, short_heads = {f[:3] for f in lexicon}, {f[:1] for f in short}
        plain = (0.0, "", (), "")

        def weight(form):
            p = max((lexicon.get(f, 0.0) for f in features_of(form)), default=0.0) if form[:3] in heads else 0.0
            return p or (short.get(squeezed(form), 0.0) if form[:1] in short_heads else 0.0)

        def traits(word):
            """The word's evidence and form, its forms that begin a lexicon word, its lone character."""
            p = (*max(((weight(f), f) for f in decoder.forms(word)), default=(0.0, "")),
                 decoder.beginnings(word, whole), decoder.lone(word))
            if len(known) >= MAX_CACHE:
                known.clear()
            known[word] = p = p if p[0] or p[2] or p[3] else plain
            return p

        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").lower().split()
                hits, starts, lone = {}, {}, {}
                for w in set(words):
                    p = known.get(w) or traits(w)
                    if p is plain:
                        continue
                    if p[0]:
                        hits[p[1]] = p[0]
                    if p[2]:
                        starts[w] = p[2]
                    if p[3]:
                        lone[w] = p[3]
                for f in (*decoder.spaced(words, lone), *decoder.pieces(words, whole, starts)):
                    if p := weight(f):
                        hits[f] = p
                clean = 1 - model["base"]
                for p in sorted(hits.values()):
                    clean *= 1 - p
                scores.append(1 - clean)
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()),
                                              pa.array(counts, pa.int64())],
                                             names=["doc_id", "score", "evidence"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, score double, evidence long"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")
