"""Scalar text functions (all JVM-side built-in expressions, no UDFs).

F1 normalize_text, F2 track_key, F3 case_fold_key, F4 id_from_uri,
F14 name search, F17 evidence label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: must equal the reference for identical track keys ---------
# The 32 ASCII punctuation characters deleted by text normalisation.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Every code point Python's str.split() treats as whitespace; runs of them
# collapse to one space. (Java's \s misses several of these.)
WHITESPACE_RUN = ("[\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680"
                  "\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
# Separator between artist and title in evidence labels (an em dash).
EVIDENCE_SEPARATOR = " — "
# ------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c) -> Column:
    """lower -> drop ASCII punctuation -> collapse Unicode whitespace -> strip."""
    lowered = F.translate(F.lower(_col(c)), ASCII_PUNCTUATION, "")
    return F.trim(F.regexp_replace(lowered, WHITESPACE_RUN, " "))


def track_key(artist, title) -> Column:
    """sha256 hex of ``norm(artist) + ' ' + norm(title)``.

    The separator stays even when a side is empty, so ("a b", "") and
    ("a", "b") hash differently.
    """
    return F.sha2(F.concat(normalize_text(artist), F.lit(" "), normalize_text(title)), 256)


def track_key_of_normalized(artist_norm, title_norm) -> Column:
    """track_key from already normalised sides (normalise per entity, e.g. on
    a dimension table before a join, then hash per row)."""
    return F.sha2(F.concat(_col(artist_norm), F.lit(" "), _col(title_norm)), 256)


def case_fold_key(c) -> Column:
    return F.lower(_col(c))


def id_from_uri(c) -> Column:
    """Last ':'-separated segment of a URI, null when empty or input null."""
    last = F.element_at(F.split(_col(c), ":"), -1)
    return F.when(last != "", last)


def name_contains(c, query: str) -> Column:
    """Case-insensitive substring search (dashboard search box)."""
    return F.contains(F.lower(_col(c)), F.lower(F.lit(query)))


def is_valid_text(c, max_len: int = 500) -> Column:
    """Something besides Unicode whitespace, and at most ``max_len`` code points."""
    col = _col(c)
    return col.isNotNull() & (F.length(F.regexp_replace(col, WHITESPACE_RUN, "")) > 0) & (F.length(col) <= max_len)
