import base64

import pytest
from pyspark.sql import functions as F

from encore.llm import blocks, bpe
from tests.llm.conftest import edge_rows

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def key(row):
    return (row[0] is not None, row[0] or 0, list(row[1]))


def test_ids_and_bytes_equal_the_library(edge_docs, ranks):
    enc = encoding(ranks)
    both = bpe.decode(bpe.encode(edge_docs, ranks, P.PATTERN), ranks).collect()
    want = [(i, enc.encode_ordinary(t or "")) for i, t in edge_rows()]
    assert sorted([(r.doc_id, r.ids) for r in both], key=key) == sorted(want, key=key)
    texts = {tuple(enc.encode_ordinary(t or "")): (t or "").encode() for _, t in edge_rows()}
    assert all(bytes(r.decoded) == texts[tuple(r.ids)] for r in both)


def test_many_small_blocks_give_the_same(edge_docs, ranks, monkeypatch):
    enc = encoding(ranks)
    monkeypatch.setattr(blocks, "CHUNK_TOKENS", 50)
    split = blocks.split_blocks.__defaults__
    monkeypatch.setattr(blocks.split_blocks, "__defaults__", (*split[:-2], 100, 20))
    got = bpe.encode(edge_docs, ranks, P.PATTERN).collect()
    want = [(i, enc.encode_ordinary(t or "")) for i, t in edge_rows()]
    assert sorted([(r.doc_id, r.ids) for r in got], key=key) == sorted(want, key=key)


def test_empty_table(no_docs, ranks):
    assert bpe.decode(bpe.encode(no_docs, ranks, P.PATTERN), ranks).count() == 0


def test_long_runs_merge_like_short_ones(ranks):
    enc = encoding(ranks)
    for piece in ("ab" * 200, "=" * 301, "thethethe" * 40, "é" * 150):
        assert bpe._merge_long(piece.encode(), ranks) == enc.encode_ordinary(piece)


def test_null_ids_decode_to_nothing_and_unknown_ids_fail(spark, ranks):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, ranks).collect()] == [b"", b""]
    bad = spark.createDataFrame([(1, [10_000_000])], "k int, ids array<int>")
    with pytest.raises(Exception, match="IndexError|index out of range"):
        bpe.decode(bad, ranks).collect()


def test_vocabulary_bound(tmp_path, monkeypatch):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(9)))
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 8)
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))


def test_digests_columns(edge_docs):
    got = bpe.digests(edge_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.dtypes[:2] == [("doc_id", "bigint"), ("n_tokens", "bigint")]
    empty = got.where(F.col("doc_id") == 4).first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == empty.decoded_sha256
