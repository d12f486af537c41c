"""Nearest neighbours and hard negatives against brute force."""

import math

import duckdb
import numpy as np
import pytest

from encore.llm import ann_forest, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string, id string, vector string"


def random_vectors(n, dim=16, seed=3, copies=0):
    """n vectors; the last `copies` are one and the same."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if copies:
        x[-copies:] = x[-1]
    return [(i, [float(v) for v in row], int(rng.integers(0, 10))) for i, row in enumerate(x)]


def odd_rows(dim=16):
    """Rows that take no part, a repeated row, and vectors of another length."""
    one = [0.5] * dim
    return [(None, one, 1), (100000, None, 1), (100050, [0.0] * dim, 2), (100100, [math.nan] * dim, 3),
            (100150, [math.inf] + one[1:], 4), (100200, [None] + one[1:], 5), (100250, [], 1),
            (200000, one, 1), (200000, one, 1), (300300, [1.0, 2.0], 1), (300400, [2.0, 1.0], 2), (300401, [-1.0, 0.25], 2),
            (300402, [1.0, 1.0], 2), (300450, one, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", "y", "z") for r in rows], SCHEMA)


def usable(rows, zero_too):
    out = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not (zero_too or any(v)):
            continue
        out.setdefault(i, (np.array(v, np.float32).astype(float), label))
    return out


def nearest(rows, k=5):
    rows = usable(rows, False)
    out = {}
    for q, (a, _) in rows.items():
        if q % 50 == 0:
            near = [(-float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())), i)
                    for i, (b, _) in rows.items() if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def test_full_budget_is_exact_over_any_shards(spark):
    rows = random_vectors(700, copies=150) + odd_rows()
    want = nearest(rows)
    for shard_rows, group in ((8192, 16384), (90, 5)):
        got = ann_forest.nearest(frame(spark, rows), shard_rows=shard_rows, query_group=group, budget=1e9).collect()
        by = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            by.setdefault(r.query_id, []).append(r)
        assert by.keys() == {q for q in want if want[q]}
        for q, found in by.items():
            assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
            assert [r.vec_id for r in found] == [i for i, _ in want[q]], q
            assert all(abs(r.score - s) < 1e-9 for r, (_, s) in zip(found, want[q]))


@pytest.mark.parametrize("n", [3000, 9000])
def test_recall_on_vectors_without_structure(spark, n):
    rows = random_vectors(n, 64)
    want = nearest(rows)
    got = ann_forest.nearest(frame(spark, rows)).collect()
    hits = {q: {i for i, _ in best} for q, best in want.items()}
    assert sum(r.vec_id in hits[r.query_id] for r in got) >= 0.93 * sum(map(len, hits.values()))


def test_budget_opens_only_part_of_the_leaves():
    x = np.random.default_rng(0).normal(size=(4096, 24))
    forest = ann_forest.Forest(np.arange(4096), x, 8, 32, 1)
    assert all(len(t.leaf_sizes) == 128 and t.leaf_sizes.max() <= 32 for t in forest.trees)
    met = forest.candidates(forest.unit[:50], 400)
    assert met.sum(axis=1).max() <= 400 + 32
    assert met[np.arange(50), np.arange(50)].all()      # a row's own leaves come first


def test_queue_is_the_best_first_search_over_all_trees():
    import heapq
    x = ann_forest.unit_rows(np.random.default_rng(5).normal(size=(300, 8)))
    rng = np.random.default_rng(1)
    trees = [ann_forest.grow(x, 10, rng) for _ in range(3)]
    for q in x[:20]:
        heap, order = [], []
        for k, t in enumerate(trees):
            heap.append((-np.inf, k, int(np.flatnonzero(t.parents == -1)[0])))
        heapq.heapify(heap)
        while heap:
            worst, k, node = heapq.heappop(heap)
            t = trees[k]
            if node >= t.n_splits:
                order.append(worst)
                continue
            margin = float(t.directions[node] @ q - t.thresholds[node])
            for child in np.flatnonzero(t.parents == node):
                heapq.heappush(heap, (max(worst, -t.signs[child] * margin), k, int(child)))
        urgency = np.concatenate([ann_forest.leaf_priorities(t, q[None]) for t in trees])[:, 0]
        assert np.allclose(np.sort(urgency), order)


def test_empty_and_lonely(spark):
    rows = frame(spark, odd_rows()[:7])
    assert ann_forest.nearest(rows).count() == 0 and hard_negatives.mine(rows).count() == 0
    assert ann_forest.nearest(frame(spark, [(0, [1.0, 2.0], 1)])).count() == 0
    few = ann_forest.nearest(frame(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [2.0, 0.0], 1)])).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 2, 1.0), (2, 1, 0.0)]


def mined(rows, flip):
    rows = {i: ([math.floor(256 * float(x)) for x in v], (label + 1) % 10 if flip and i % 7 == 0 else label)
            for i, (v, label) in usable([r for r in rows if r[2] is not None], True).items()}
    out = []
    for a, (x, label) in rows.items():
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, lab == label)
                        for i, (y, lab) in rows.items() if i != a and len(x) == len(y))
        for s, p, _ in [r for r in scored if r[2]][:5]:
            fit = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("anchor_block,row_block,cells", [(16384, 32768, 1 << 22), (3, 70, 100)])
def test_negatives_equal_brute_force(spark, monkeypatch, anchor_block, row_block, cells):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", anchor_block)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", row_block)
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    rows = random_vectors(900, 6, copies=200) + odd_rows(6)
    rows += [(1000 + i, [0.0] * 6, i % 3) for i in range(40)]       # scores of zero: windows of one score
    got = hard_negatives.mine(frame(spark, rows), flip_mod=7).collect()
    assert sorted(map(tuple, got)) == mined(rows, True)
    assert any(r.positive_score == 0 for r in got)


def test_statement_of_negatives_equals_brute_force():
    rows = [r for r in random_vectors(900, 6) if r[1]] + [(1000, [0.0] * 6, 1), (1001, [0.0] * 6, 1), (1002, [0.1] * 6, 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    order = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert sorted(con.sql(f"SELECT {order} FROM ({hard_negatives.SQL})").fetchall()) == mined(rows, True)


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0 ** 53, 1.0], [3.0, -1.0]])
    assert hard_negatives.pair_scores(a, a).tolist()[0] == [(1 << 63) - 1, 3 * 2 ** 53 - 1]
    for score in (-7, -1, 0, 1, 9, 10, 11, 12345, (1 << 62) + 3):
        low, high = hard_negatives.window_bounds(score, 30, 90)
        assert low == -((-30 * score) // 100) and high == 90 * score // 100


def test_keys_sort_as_their_fields():
    keys = [(a, s, n, i) for a in (-5, 0, 300) for s in (-(1 << 63), -1, 0, (1 << 63) - 1) for n in (False, True)
            for i in (-1, 0, 7)]
    assert [hard_negatives.unpack(k) for k in sorted(hard_negatives.pack(*k) for k in keys)] == sorted(
        keys, key=lambda k: (k[0], -k[1], k[2], k[3]))
