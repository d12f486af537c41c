"""Golden cases for text normalisation, track keys and scoring (our own
tables, covering the cases the reference pins)."""

import hashlib
import string

import pytest

from encore.functions.scoring import artist_score, genre_novelty_ratio, score_breakdown, valid_ratio
from encore.functions.text import normalize_text, track_key

_TABLE = str.maketrans("", "", string.punctuation)


def py_norm(s):
    return " ".join(s.lower().translate(_TABLE).split())


TEXT_CASES = [
    ("Radiohead", "radiohead"),
    ("AC/DC", "acdc"),
    ("Guns  N'   Roses", "guns n roses"),
    ("Sigur Rós", "sigur rós"),
    ("", ""),
    ("!!!", ""),
    ("   \t\n ", ""),
    ("Blink-182", "blink182"),
    ("a b c\u001cd\u0085e", "a b c d e"),
    ("Мумий Тролль", "мумий тролль"),
    ("x" * 10000, "x" * 10000),
    ("Café — Déjà vu", "café — déjà vu"),
]


@pytest.mark.parametrize("raw,expected", TEXT_CASES)
def test_normalize_text_cases(spark, raw, expected):
    assert py_norm(raw) == expected
    got = spark.createDataFrame([(raw,)], "s string").select(normalize_text("s").alias("n")).first().n
    assert got == expected


def test_track_key_separator_kept(spark):
    df = spark.createDataFrame([("a b", ""), ("a", "b"), ("A.", "B!")], "a string, t string")
    keys = [r.k for r in df.select(track_key("a", "t").alias("k")).collect()]
    assert keys[0] != keys[1]
    assert keys[1] == keys[2] == hashlib.sha256(b"a b").hexdigest()
    assert keys[0] == hashlib.sha256(b"a b ").hexdigest()


SCORE_CASES = [
    # ratio, popularity, high_priority, score, genre part, popularity part
    (0.8, 20, False, 0.80, 0.48, 0.32),
    (0.0, None, False, 0.40, 0.0, 0.4),
    (0.5, 50, True, (0.3 + 0.2) * 1.2, 0.3, 0.2),
    (1.0, 0, True, 1.0, 0.6, 0.4),
    (0.0, 100, False, 0.0, 0.0, 0.0),
]


@pytest.mark.parametrize("ratio,pop,hp,score,gn,pn", SCORE_CASES)
def test_artist_score(spark, ratio, pop, hp, score, gn, pn):
    df = spark.createDataFrame([(ratio, pop, hp)], "r double, p int, hp boolean")
    row = df.select(artist_score("r", "p", "hp").alias("s"), score_breakdown("r", "p").alias("b")).first()
    assert row.s == pytest.approx(score)
    assert row.s <= 1.0 and row.s >= 0.0
    assert row.b.genre_novelty == pytest.approx(gn)
    assert row.b.popularity_norm == pytest.approx(pn)


def test_ratio_validity(spark):
    df = spark.createDataFrame([(-0.1,), (1.1,), (0.0,), (1.0,), (None,), (float("nan"),)], "r double")
    got = [r.v for r in df.select(valid_ratio("r").alias("v")).collect()]
    assert got == [False, False, True, True, False, False]


def test_novelty_ratio_cases(spark):
    rows = [(["a", "b"], ["a", "b"]), (["a", "b"], []), (["a", "b", "c"], ["b"]), ([], [])]
    df = spark.createDataFrame(rows, "g array<string>, n array<string>")
    got = [r.x for r in df.select(genre_novelty_ratio("n", "g").alias("x")).collect()]
    assert got == pytest.approx([1.0, 0.0, 1 / 3, 0.0])
