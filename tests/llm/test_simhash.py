import numpy as np
import pytest
import xxhash

from encore.llm import components as graph
from encore.llm import simhash
from encore.llm.components import connected_components
from tests.llm.conftest import edge_rows, prose


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fps, bits=3):
    """Union of all pairs by brute force: fingerprint -> representative."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("group_limit", [4096, 1])
def test_equals_brute_force(spark, group_limit):
    base = prose(5, 300).split()
    texts = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in range(0, 300, 4)]
    rows = [*edge_rows(), *((100 + i, t) for i, t in enumerate(texts)), *((300 + i, prose(i, 50)) for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, group_limit=group_limit).collect()
    assert len(got) == len(rows)
    roots = components([fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        r = roots[fingerprint(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((i is not None, i or 0, fingerprint(t), least.get(roots[fingerprint(t)], -1)) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, int(np.int64(r.fp).view(np.uint64)),
                   -1 if r.component_id is None else r.component_id) for r in got) == want


def test_every_close_pair_shares_a_mask():
    rng = np.random.default_rng(1)
    masks = simhash.block_masks(6, 3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)


def test_empty_table_and_long_chain(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (200, 199), (199, 200)], "u long, v long")
    got = {r.vertex: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 199: 199, 200: 199}


def test_counts_over_many_lanes():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    sizes = np.array([1, 255, 256, 1488])
    got = simhash.bit_counts(hashes, sizes)
    at = 0
    for row, n in zip(got, sizes):
        part = hashes[at:at + n]
        at += n
        assert [int(((part >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(64)] == row.tolist()


def test_rounds_of_few_edges_are_landed_in_few_files(spark, monkeypatch):
    files = []

    def landed(df, name):
        out = land(df, name)
        files.append(len(out.inputFiles()))
        return out

    land = graph.land
    monkeypatch.setattr(graph, "land", landed)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49], "u long, v long")
        got = {r.vertex: r.root for r in graph.connected_components(edges).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: i // 50 * 50 for i in range(200)}
    assert len(files) > 2 and set(files[1:]) == {1}


@pytest.mark.parametrize("group_limit", [4096, 1])
def test_links_and_result_are_written_in_few_files(spark, monkeypatch, tmp_path, group_limit):
    files = {}

    def landed(df, name):
        out = land(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    land = simhash.land
    monkeypatch.setattr(simhash, "land", landed)
    monkeypatch.setattr(graph, "land", landed)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    base = prose(5, 300).split()
    rows = [*((i, prose(i, 50)) for i in range(40)), *((100 + k, " ".join(base[:k] + ["changed"] + base[k + 1:]))
                                                       for k in range(0, 300, 4))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    search = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: search(docs, group_limit=group_limit))
    try:
        simhash.op10_simhash(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    roots = components([fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        least.setdefault(roots[fingerprint(t)], i)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == [
        (i, f"{fingerprint(t):016x}", least[roots[fingerprint(t)]]) for i, t in rows]
    assert len(got.inputFiles()) == 1
    assert files.pop("simhash") == [2] and ("simhash-dense" in files) == (group_limit == 1)
    assert all(n <= 2 for some in files.values() for n in some), files
