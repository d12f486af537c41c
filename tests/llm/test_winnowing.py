import re

from encore.llm import winnowing
from tests.llm.conftest import edge_rows, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            v = words(it)
            m = min(window, len(v))
            grams = {tuple(v[p:p + m]) for p in range(len(v) - m + 1)} if m else set()
            for p in range(len(w) - m + 1 if m else 0):
                if tuple(w[p:p + m]) in grams:
                    hit.update(range(p, p + m))
                    if item is not None:
                        found.add(str(item))
        out.append((i is not None, i or 0, len(w), len(hit), sorted(found)))
    return sorted(out)


def run(docs, items):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r["items"])
                  for r in winnowing.decontaminate(docs, items).collect())


def items_rows():
    return [(1, prose(1, 40)), (2, prose(3, 12)), (3, "a"), (4, None), (5, ""), (None, prose(2, 30)), (6, "漢字 EMOJI"),
            (7, prose(1, 40)), (7, prose(1, 40)), (8, "alpha " * 50), (10, prose(7, 9))]


def test_equals_brute_force(spark, edge_docs):
    more = [(50, "alpha " * 120), (51, prose(9, 30) + " " + prose(7, 9).upper() + " " + prose(9, 5)),
            (52, prose(1, 9)), (53, prose(1, 10) + ". " + prose(4, 3) + "-" + prose(1, 40)[20:])]
    docs = edge_docs.select("doc_id", "text", "words").union(
        spark.createDataFrame([(i, t, "x") for i, t in more], "doc_id long, text string, words string"))
    items = spark.createDataFrame([(i, t, "y") for i, t in items_rows()], "item_id long, text string, fps string")
    assert run(docs, items) == brute([*edge_rows(), *more], items_rows())


def test_shuffle_joins_give_the_same(edge_docs, spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", -1)
    items = spark.createDataFrame(items_rows(), "item_id long, text string")
    assert run(edge_docs, items) == brute(edge_rows(), items_rows())


def test_empty_tables(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(no_docs, none) == []
    assert run(edge_docs, none) == brute(edge_rows(), [])


def test_no_python_in_the_plan(edge_docs, spark, capsys):
    items = spark.createDataFrame(items_rows(), "item_id long, text string")
    winnowing.decontaminate(edge_docs, items).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
