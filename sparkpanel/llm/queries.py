"""The registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from sparkpanel.llm import bag_search, block_knn, byte_bpe, hard_negatives, hmm, lang_tree, mix_tree, partition_join, perm_shards, risk_rules, url_lm, warc, winnow

QUERIES = {
    "op1_url_lm": url_lm.query,
    "op2_block_knn": block_knn.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_risk_rules": risk_rules.query,
    "op5_mix_tree": mix_tree.query,
    "op6_winnow": winnow.query,
    "op7_partition_join": partition_join.query,
    "op9_hmm": hmm.query,
    "op10_lang_tree": lang_tree.query,
    "op8_perm_shards": perm_shards.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_bag_search": bag_search.query,
    "op13_warc": warc.query,
}

ORACLES = {
    "op2_block_knn": block_knn.ORACLE,
    "op4_risk_rules": risk_rules.oracle(),
    "op8_perm_shards": perm_shards.oracle(),
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_bag_search": bag_search.ORACLE,
    "op13_warc": warc.ORACLE,
}
