import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from encore.llm import line_dedup
from tests.llm.conftest import edge_rows, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for k, y in enumerate(b, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, edits=2, least=24):
    """doc_id -> text left, by comparing every two lines."""
    def used(x):
        return len(x) >= least and x.strip(" \t\r\x0b\x0c")
    first = {}
    for i, t in rows:
        for no, x in enumerate((t or "").split("\n")):
            if used(x):
                place = (i is not None, i or 0, no)
                first[x] = min(first.get(x, place), place)
    repeats = {x for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= edits
               and distance(x, y) <= edits}
    out = []
    for i, t in rows:
        stay = [x for no, x in enumerate((t or "").split("\n"))
                if not used(x) or (first[x] == (i is not None, i or 0, no) and x not in repeats)]
        out.append((i is not None, i or 0, None if t is None else "\n".join(stay), (t or "").count("\n") + 1))
    return out


def edited(rng, line, edits):
    x = list(line)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(x))
        if kind == 0:
            x.insert(at, rng.choice("abcé"))
        elif kind == 1:
            del x[at]
        else:
            x[at] = rng.choice("abcé")
    return "".join(x)


def near_rows():
    rng, base = random.Random(4), [prose(s, 6) for s in range(12)]
    return [(100 + d, "\n".join(edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(4))) for d in range(40)]


def run(docs, **kw):
    def key(r):
        return (r[0], r[1], r[2] is not None, r[2] or "", r[3])
    got = line_dedup.dedup_lines(docs, **kw).collect()
    assert all(r.n_removed == r.n_lines - len((r.text or "").split("\n")) or not (r.text or "") for r in got)
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines) for r in got), key=key), key


@pytest.mark.parametrize("chunk,few", [(2000, 16), (3, 2), (2, 1)])
def test_equals_brute_force(spark, edge_docs, chunk, few):
    rows = [*[r for r in edge_rows() if r[0] != 7], *near_rows()]
    docs = edge_docs.where("doc_id is null or doc_id != 7").select("doc_id", "text").union(
        spark.createDataFrame(near_rows(), "doc_id long, text string"))
    got, key = run(docs, chunk=chunk, few=few)
    assert got == sorted(brute(rows), key=key)


def test_large_keys_over_several_batches(spark):
    """Templated lines share segments: keys of over `chunk` rows that begin and end inside small Arrow batches."""
    rng = random.Random(9)
    rows = [(d, "\n".join(f"{rng.choice('abcdef')}emplate line numbe{rng.choice('rstuvw')} of many pages{rng.choice('xyz')}"
                          for _ in range(3))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    pairs = []
    try:
        spark.conf.set(names[1], "1")
        for size in ("10000", "5", "7", "11", "16", "23"):
            spark.conf.set(names[0], size)
            pairs.append({tuple(r) for r in line_dedup.kept_places(docs, 2, 24, 3, 3).collect()})
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert pairs[0] and all(p == pairs[0] for p in pairs)


def test_texts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    got, key = run(spark.createDataFrame(near_rows(), "doc_id long, text string"))
    assert got == sorted(brute(near_rows()), key=key)


def test_columns_and_empty_table(edge_docs, no_docs):
    got = line_dedup.dedup_lines(edge_docs)
    assert got.columns == [*edge_docs.columns, "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert got.where(F.col("doc_id") == 13).first().n_removed == 29


def test_banded_distance():
    rng = random.Random(7)
    for edits in (1, 2, 3):
        a = [prose(s, 2 + s % 9) for s in range(300)]
        b = [edited(rng, x, rng.randrange(5)) for x in a]
        pairs = [(x, y) for x, y in zip(a, b) if abs(len(x) - len(y)) <= edits]
        got = line_dedup.banded_distance([x for x, _ in pairs], [y for _, y in pairs], edits)
        for (x, y), d in zip(pairs, got):
            want = distance(x, y)
            assert d == want if want <= edits else d > edits


def test_ids_are_of_the_whole_line():
    assert line_dedup.line_id("a" * 100) != line_dedup.line_id("a" * 99 + "b")
    assert hashlib.sha256(line_dedup.line_id("x")).digest()


def test_rows_stay_linear_in_a_group_of_near_copies(spark):
    """Each of n lines is one edit away from a common line that comes first: one row per line leaves a task."""
    base = prose(3, 12)
    made = []
    for n in (100, 400):
        rows = [(0, base)] + [(1 + i, base[:i % 60] + chr(0x4E00 + i) + base[i % 60 + 1:]) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        places = line_dedup.first_places(docs, 24).cache()
        met = line_dedup.meetings(docs, 2, 24, 16).cache()
        lines = line_dedup.texts_of(docs, met.selectExpr("explode(array(a, b)) as short").where("short is not null"), 24)
        found = line_dedup.repeats_under_large_keys(met.where("b is null").distinct(), lines, places, 2, 2000)
        made.append((met.count(), found.count()))
        assert found.distinct().count() == n
        assert line_dedup.dedup_lines(docs).where("n_removed = 1").count() == n
    assert all(large <= 5 * small for small, large in zip(*made))


def test_very_long_line_and_very_many_lines(spark):
    long_line = prose(1, 150_000)
    assert len(long_line) > 800_000
    many = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000))
    rows = [(1, long_line), (2, long_line), (3, long_line[:400_000] + "x" + long_line[400_001:]), (4, many),
            (5, "short but long enough to be compared\nshort but long enough to be comparex")]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
           .select("doc_id", "n_removed").collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [0, 1, 1, 1]


def test_names_that_clash(spark):
    rows = [(1, "the same long line of words here", 7, 8, [1], "k"), (2, "the same long line of words here", 7, 8, [2], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, n_lines int, kept array<int>, row string")
    got = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, rows[0][1], [1], "k", 1, 0), (2, "", [2], "k", 1, 1)]


def test_common_ends_keep_the_distance():
    rng = random.Random(11)
    pairs = [(x, edited(rng, x, rng.randrange(5))) for x in (prose(s, 60) for s in range(60))]
    pairs += [("aaaa" * 80, "aaaa" * 80 + "aa"), ("ab" * 150, "ab" * 149), ("x" * 300, "x" * 299 + "y"), ("é" * 201, "é" * 201)]
    got = line_dedup.within([x for x, _ in pairs], [y for _, y in pairs], 2)
    assert got.tolist() == [abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for x, y in pairs]


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_cell_of_near_copies_is_compared_in_pieces():
    # every line of one side is close to every line of the other: a million pairs
    base = prose(4, 20)[:100]
    lines = [base + f"{i % 10}{i // 10 % 10}" for i in range(100)] * 20
    ids = [line_dedup.line_id(x) for x in lines]
    sig = line_dedup.signatures(lines)
    rows = [(int(sig[n]), n % 2 == 0, ids[n], lines[n], (True, n, 0)) for n in range(len(lines))]
    got = []
    assert peak_mb(lambda: got.append(line_dedup.candidates(rows, 2))) < 60
    late, early = got[0]
    expected = {(max(i, k), min(i, k)) for i in range(0, 2000, 2) for k in range(1, 2000, 2) if ids[i] != ids[k]}
    assert set(zip(late.tolist(), early.tolist())) == expected and len(late) == len(expected)
    assert sorted(set(late.tolist())) == late[[0, *(1 + i for i in range(len(late) - 1) if late[i] != late[i + 1])]].tolist()
    found = line_dedup.search(ids, lines, late[:5_000], early[:5_000], 2)
    assert set(found) == {ids[n] for n in late[:5_000].tolist()}


def test_hashing_many_lines_holds_little():
    lines = [prose(s, 30) for s in range(12_000)]

    def work():
        for part in line_dedup._batches_of(lines):
            for _ in line_dedup.join_keys(part, 2, 24):
                pass

    assert sum(map(len, lines)) > 1_500_000 and peak_mb(work) < 30
