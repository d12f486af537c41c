"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document: the ledger keeps the measurements
and one failure bit per rule. Policies are versioned masks over the bits, so
a policy is applied, changed or ablated without reading a text again.

Null and empty texts have no words: all measurements are zero and `few_words`
fails. Every input row gives one ledger row (repeated rows and null ids too);
an empty table gives an empty ledger. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import UPPER, prepare, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _c(name: str) -> Column:
    return F.col(name)


def rules() -> list[tuple[str, Column]]:
    """Name and failing condition over the measurements; the bit is the place in the list."""
    return [
        ("few_words", _c("n_words") < 50),
        ("repeated_words", 100 * _c("n_repeat_words") > 50 * _c("n_words")),
        ("duplicate_lines", 10 * _c("n_dup_lines") > 5 * _c("n_lines")),
        ("symbols", 10 * _c("n_symbols") > 3 * _c("n_words")),
        ("short_words", _c("word_chars") < 2 * _c("n_words")),
        ("long_words", _c("word_chars") > 20 * _c("n_words")),
        ("capitals", 10 * _c("n_capitals") > 6 * _c("word_chars")),
    ]


# versioned policies: the rules that reject
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": ("few_words", "repeated_words", "duplicate_lines", "symbols", "short_words",
               "long_words", "capitals"),
}


def policy_mask(policy: str) -> int:
    names = [n for n, _ in rules()]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every row."""
    prepare(docs.sparkSession)
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(
        "doc_id",
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).alias("n_capitals"))
    w, n = F.col("words"), F.size("words")
    # hash and place of every three-word window, equal windows side by side
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))))
    base = base.select("*", n.alias("n_words"), F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                       windows.alias("windows"))
    s = F.col("windows")
    twice = F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["at"]))
    base = base.select("*", twice.alias("twice")).drop("windows", "words", "lines")
    t = F.col("twice")
    # each such window adds its words up to the next one's start
    added = F.transform(t, lambda p, i: F.least(F.coalesce(F.get(t, i + 1) - p, F.lit(3)), F.lit(3)))
    covered = F.aggregate(added, F.lit(0), lambda a, x: a + x)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals"]
    return base.select("doc_id", *[F.col(m).cast("long").alias(m) for m in measures],
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `failed`: bit i is set if rule i fails."""
    bits = [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failed", total.cast("long"))


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents it fails, and those kept if it alone were dropped.

    One pre-aggregated count per distinct mask (2^rules at most), then bitwise
    tests of the masks.
    """
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy_mask(policy))).alias("mask")).count()
    names = [n for n, _ in rules()]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).alias("bit"))
                               for n in POLICIES[policy]]))
    each = masks.select("*", rows.alias("r")).select("mask", "count", "r.*")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask").isin(0) | (F.col("mask") == F.col("bit")), F.col("count")).otherwise(0))
        .alias("kept_without"),
        F.bit_or(F.when(hit, F.col("mask")).otherwise(0)).alias("fails_with"))


def op8_rule_ledger(spark, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes("base-1")).alias("base_failed"),
                       (passes("base-1") & passes("full-1")).alias("kept"),
                       "n_lines", "n_capitals", "failed")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n >= 2
), rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([p, p + 1, p + 2]) AS at FROM twice) GROUP BY r
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN rep USING (r)
), f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (10 * n_dup_lines > 5 * n_lines)::INT + 8 * (10 * n_symbols > 3 * n_words)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (10 * n_capitals > 6 * word_chars)::INT AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed & 127 = 0 AS kept, n_lines, n_capitals, failed FROM f
"""
