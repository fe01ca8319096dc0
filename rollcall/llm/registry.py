"""The queries of the corpus operators, and SQL where it can say them."""

from __future__ import annotations

from . import chat_format, hilbert_shards, host_rules, imatch, jaccard_join, line_dedup, packed_ids, pfair_mix, phrases, suffix_pieces, turn_trie, weak_toxicity, whole_tokens

QUERIES = {
    "op1_hilbert_shards": hilbert_shards.query,
    "op2_whole_tokens": whole_tokens.query,
    "op3_imatch": imatch.query,
    "op4_pfair_mix": pfair_mix.query,
    "op5_chat_format": chat_format.query,
    "op6_packed_ids": packed_ids.query,
    "op7_suffix_pieces": suffix_pieces.query,
    "op8_weak_toxicity": weak_toxicity.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_host_rules": host_rules.query,
    "op11_pivot_phrases": phrases.query,
    "op12_turn_trie": turn_trie.query,
    "op13_line_dedup": line_dedup.query,
}
#: The others can't be said in SQL; tests hold them against brute-force versions or the tokenizers' own libraries.
ORACLES = {
    "op5_chat_format": chat_format.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_host_rules": host_rules.ORACLE_SQL,
    "op11_pivot_phrases": phrases.ORACLE_SQL,
    "op12_turn_trie": turn_trie.ORACLE_SQL,
    "op13_line_dedup": line_dedup.ORACLE_SQL,
}
