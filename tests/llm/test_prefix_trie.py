import hashlib
import zlib

import duckdb
import pytest

from encore.llm import prefix_trie
from tests.llm.conftest import prose

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs double, ends string, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie by a dictionary of prefixes; `rows` without ties of one turn."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for path, ids in members.items():
        under = [q for q in members if q[:len(path)] == path]
        kids = [q for q in under if len(q) == len(path) + 1]
        leaves = [q for q in under if not any(r[:-1] == q for r in members if r)]
        saved = sum((len(members[q]) - 1) * len((q[-1][1]).split()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ids if seqs[c] == path)))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids), len(leaves),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of_all_kinds():
    rows = [(i, t, ("user", "assistant")[t % 2], prose(i // 4 if t < 2 else i // 2, 3 + t))
            for i in range(70) for t in range(i % 6)]
    rows += [(200 + i, t, "user", "the same words") for i in range(40) for t in range(3)]     # copies
    rows += [(300, None, None, None), (300, 0, "user", ""), (301, 1, "a", "x\ny z"), (None, 0, "user", "lost"),
             (320, 0, "user", prose(9, 20000)), (321, 0, "", None), (322, 1, None, ""), (-3, 0, "user", "minus")]
    rows += [(400, t, "user", "again") for t in range(300)]
    return rows


@pytest.mark.parametrize("cells,block_rows", [(1 << 21, 1 << 16), (60, 3), (1, 1)])
def test_equals_brute_force_however_the_blocks_fall(spark, cells, block_rows):
    rows = rows_of_all_kinds()
    frame = spark.createDataFrame([(*r, "x", 0.5, None, "p") for r in rows], SCHEMA)
    convs = prefix_trie.rebuilt(prefix_trie.conversations(frame))
    got = prefix_trie.trie(convs, cells, block_rows).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_repeated_turns_and_empty_tables(spark):
    twice = spark.createDataFrame([(0, 1, "u", "b"), (0, 1, "u", "b"), (0, 0, "u", "a a")],
                                  "conv_id long, turn int, role string, text string")
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(twice))).orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [
        (0, 1, 1, 1, 0), (1, 1, 1, 1, 0), (2, 1, 1, 1, 0), (3, 1, 0, 1, 0)]
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(twice.where("false")))).count() == 0


def test_turnless_conversations_end_in_the_root(spark):
    # crc32("24") % 4 = 3 and its head is absent: nothing is left of two turns
    assert zlib.crc32(b"24") % 4 == 3
    two = spark.createDataFrame([(24, 0, "u", "a"), (24, 1, "u", "b")], "conv_id long, turn int, role string, text string")
    (root,) = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(two))).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves) == (
        24, 0, None, 1, 0, 1)
    assert root.ends_sha256 == hashlib.sha256(b"24").hexdigest()


def test_statement_equals_brute_force():
    rows = [r for r in rows_of_all_kinds() if r[0] is None or r[0] >= 0]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.SQL})").fetchall()
    assert sorted(got, key=str) == brute(rows)
