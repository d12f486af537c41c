import re
from collections import Counter

from pyspark.sql import functions as F

from encore.llm import rule_ledger
from tests.llm.conftest import edge_rows


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + d for i, g in enumerate(windows) if n[g] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measurements_equal_brute_force(edge_docs):
    got = rule_ledger.ledger(edge_docs).collect()
    want = sorted((i is not None, i or 0, *brute(t)) for i, t in edge_rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                   r.n_repeat_words) for r in got) == want
    for r in got:
        assert bool(r.failed & 1) == (r.n_words < 50)
        assert bool(r.failed & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablations(edge_docs, no_docs):
    book = rule_ledger.ledger(edge_docs).cache()
    masks = [r.failed for r in book.collect()]
    names = [n for n, _ in rule_ledger.rules()]
    for policy in rule_ledger.POLICIES:
        mask = rule_ledger.policy_mask(policy)
        assert book.where(rule_ledger.passes(policy)).count() == sum(m & mask == 0 for m in masks)
        for r in rule_ledger.ablations(book, policy).collect():
            bit = 1 << names.index(r.rule)
            assert r.n_failed == sum(m & bit != 0 for m in masks)
            assert r.kept_without == sum(m & mask & ~bit == 0 for m in masks)
    assert rule_ledger.ledger(no_docs).count() == 0


def test_no_python_in_the_plan(edge_docs, capsys):
    rule_ledger.ledger(edge_docs).select(F.col("failed")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
