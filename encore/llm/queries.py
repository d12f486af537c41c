"""Registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from encore.llm import (
    ann_forest,
    attention_mil,
    bpe,
    chat_format,
    hard_negatives,
    line_dedup,
    neural_lm,
    prefix_trie,
    rule_ledger,
    simhash,
    toxicity,
    warc,
    winnowing,
)

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_attention_mil": attention_mil.op3_attention_mil,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_winnowing": winnowing.op5_winnowing,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_warc": warc.op7_warc,
    "op8_rule_ledger": rule_ledger.op8_rule_ledger,
    "op9_neural_lm": neural_lm.op9_neural_lm,
    "op10_simhash": simhash.op10_simhash,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_ann_forest": ann_forest.op12_ann_forest,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL,
    "op5_winnowing": winnowing.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_warc": warc.SQL,
    "op8_rule_ledger": rule_ledger.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
