"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text is a sequence of words; the hash of each k-gram is computed, and
of each run of `window - k + 1` consecutive k-grams (that is, of `window`
words) the minimum is kept as a fingerprint. A document and an item that
share `window` consecutive words share all k-grams of that run, hence its
minimum: no shared span of that length is missed. Fingerprints are joined,
and each hit is verified word by word and extended to both sides.

An item of fewer than `window` words (but some) is one window: its whole
word sequence is its fingerprint, met by all document n-grams of its length.

Null and empty texts have no words, no hits and no items. The result is a
function of the text, so repeated rows give equal rows; a null doc_id keeps
its row, a null item_id hits words but is not listed. An empty benchmark
gives no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import ascii_lower, land, prepare, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000    # fingerprints joined by broadcast, as counted; a shuffle join beyond


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_hashes(hashes: Column, n: Column, m: int, salt: int) -> Column:
    """Hashes of the m-grams, in order; an empty array for fewer words."""
    def at(i):
        return F.xxhash64(F.lit(salt), *[F.get(hashes, i + j) for j in range(m)])
    return F.when(n >= m, F.transform(F.sequence(F.lit(0), n - m), at)).otherwise(F.array().cast("array<bigint>"))


def winnowed(grams: Column, per_window: int) -> Column:
    """Distinct minima over every run of `per_window` grams."""
    def least(i):
        return F.least(*[F.get(grams, i + j) for j in range(per_window)]) if per_window > 1 else F.get(grams, i)
    return F.when(F.size(grams) >= per_window, F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.size(grams) - per_window), least))) \
        .otherwise(F.array().cast("array<bigint>"))


def with_hashes(df: DataFrame) -> DataFrame:
    return (df.withColumn("n_words", F.size("words"))
            .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))))


def side(words: Column, start: Column, length: int, leftwards: bool) -> Column:
    """Up to `length` words beside a gram, the nearest first."""
    if not leftwards:
        return F.slice(words, start + 1, length)
    begin = F.greatest(start - length, F.lit(0))
    return F.reverse(F.slice(words, begin + 1, start - begin))


def equal_run(a: Column, b: Column) -> Column:
    """How many leading words agree."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def grams_at(df: DataFrame, keep: Column, window: int, k: int, short: list[int]) -> DataFrame:
    """A row per gram whose hash is in the array column `keep`, with its words and both sides."""
    def positions(grams, m):
        return F.filter(F.transform(grams, lambda h, i: F.struct(h.alias("fp"), i.alias("at"),
                                                                 F.lit(m).alias("m"))),
                        lambda x: F.array_contains(keep, x["fp"]))
    arrays = [positions(F.col("grams"), k)]
    arrays += [positions(gram_hashes(F.col("hashes"), F.col("n_words"), m, m), m) for m in short]
    out = df.withColumn("gram", F.explode(F.concat(*arrays))).select(
        "*", F.col("gram.fp").alias("fp"), F.col("gram.at").alias("at"), F.col("gram.m").alias("m"))
    words, at, m = F.col("words"), F.col("at"), F.col("m")
    return (out.withColumn("mid", F.slice(words, at + 1, m))
            .withColumn("before", side(words, at, window - k, True))
            .withColumn("after", side(words, at + m, window - k, False))
            .drop("gram", "grams", "hashes", "words"))


def item_contexts(items: DataFrame, window: int, k: int, item_col: str, text_col: str
                  ) -> tuple[DataFrame, list[int]]:
    """Distinct fingerprints of the items with the words around them, and the lengths of short items."""
    base = with_hashes(items.select(F.col(item_col).cast("string").alias("item"),
                                    words_of(F.col(text_col)).alias("words"))).where("n_words > 0")
    short = sorted(r[0] for r in base.where(F.col("n_words") < window).select("n_words").distinct().collect())
    base = base.withColumn("grams", gram_hashes(F.col("hashes"), F.col("n_words"), k, 0))
    keep = winnowed(F.col("grams"), window - k + 1)
    for m in short:
        keep = F.concat(keep, F.when(F.col("n_words") == m, gram_hashes(F.col("hashes"), F.col("n_words"), m, m))
                        .otherwise(F.array().cast("array<bigint>")))
    rows = grams_at(base.withColumn("keep", keep), F.col("keep"), window, k, short)
    rows = rows.withColumn("whole", F.col("n_words") < window)
    return rows.groupBy("fp", "m", "whole", "mid", "before", "after").agg(
        F.collect_set("item").alias("items")), short


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of `docs`.

    n_hit counts the words inside any occurrence of a window of an item;
    `items` is the sorted array of the items (as strings) with such windows.
    """
    prepare(docs.sparkSession)
    contexts, short = item_contexts(items, window, k, item_col, item_text_col)
    contexts = land(contexts, "winnow-items")
    known = contexts.select("fp").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    base = docs.select(F.col(id_col).alias("doc_id"),
                       F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"),
                       words_of(F.col(text_col)).alias("words"))
    base = with_hashes(base).withColumn("grams", gram_hashes(F.col("hashes"), F.col("n_words"), k, 0))
    fps = winnowed(F.col("grams"), window - k + 1)
    for m in short:
        fps = F.array_union(fps, gram_hashes(F.col("hashes"), F.col("n_words"), m, m))
    prints = land(base.select("doc_id", "key", "n_words", fps.alias("fps")), "winnow-docs")

    matched = land(prints.select("doc_id", "key", F.explode("fps").alias("fp")).join(known, "fp")
                   .groupBy("doc_id", "key").agg(F.collect_set("fp").alias("keep")), "winnow-matched")
    rows, held = matched.agg(F.count("*"), F.coalesce(F.sum(F.size("keep")), F.lit(0))).first()
    if rows + held <= BROADCAST_ROWS:
        matched = F.broadcast(matched)
    # the raw texts are joined, so that only those with a known fingerprint are cut into words again
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hit_docs = texts.withColumn("key", F.unhex(F.md5("text"))) \
        .join(matched.select(F.col("doc_id").alias("d"), F.col("key").alias("h"), "keep"),
              F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h"))) \
        .dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "keep", words_of(F.col("text")).alias("words"))
    hit_docs = with_hashes(hit_docs).withColumn("grams", gram_hashes(F.col("hashes"), F.col("n_words"), k, 0))

    grams = grams_at(hit_docs, F.col("keep"), window, k, short).drop("keep", "n_words")
    theirs = contexts.select("fp", "m", "whole", "mid", F.col("before").alias("item_before"),
                             F.col("after").alias("item_after"), "items")
    met = grams.join(theirs, ["fp", "m", "mid"])
    back = F.when(F.col("whole"), 0).otherwise(equal_run(F.col("before"), F.col("item_before")))
    on = F.when(F.col("whole"), 0).otherwise(equal_run(F.col("after"), F.col("item_after")))
    spans = land(met.withColumn("back", back).withColumn("on", on)
             .where(F.col("whole") | (F.col("back") + F.col("m") + F.col("on") >= window))
             .select("doc_id", "key", "items", (F.col("at") - F.col("back")).alias("from"),
                     (F.col("at") + F.col("m") + F.col("on") - 1).alias("to")), "winnow-spans")
    # positions without the items, and items without the positions
    at = spans.select("doc_id", "key", F.explode(F.sequence("from", "to")).alias("at")).distinct()
    hits = at.groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"))
    names = spans.select("doc_id", "key", F.explode("items").alias("item")).distinct()
    named = names.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("h")).agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    left = prints.select("doc_id", "key", "n_words")
    right = hits.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h")), "left").select(
        F.col("doc_id").alias("d"), F.col("key").alias("h"), "n_hit", "items")
    return (left.join(right, left["doc_id"].eqNullSafe(F.col("d")) & (left["key"] == F.col("h")), "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def op5_winnowing(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


# Windows by definition: every run of ten words of an item (all words of a
# shorter one), looked up among the runs of the same length of a document.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lengths AS (SELECT DISTINCT least(len(w), 10) AS m FROM i WHERE len(w) > 0
), wi AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
    FROM i WHERE len(w) > 0)
), wd AS (
  SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (
    SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lengths WHERE len(w) >= m)
), met AS (SELECT r, p, m, item_id FROM wd JOIN wi USING (m, g)
), hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS at FROM met) GROUP BY r
), its AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
