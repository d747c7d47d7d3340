"""The queries of this subpackage and the SQL of those that SQL can express; checksums, hashing, models and tokenizers are beyond it, so tests compare the others with brute force."""

from __future__ import annotations

from . import brown, edits, html, leaks, packing, quality, redirects, sharding, simhash, substrings, toxicity, trie, whitening

QUERIES = {
    "op1_divergence": quality.op1_divergence,
    "op2_brown": brown.op2_brown,
    "op3_byte_shards": sharding.op3_byte_shards,
    "op4_edit_counts": edits.op4_edit_counts,
    "op5_main_text": html.op5_main_text,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_config_packing": packing.op7_config_packing,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_decontaminate": leaks.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
    "op11_redirects": redirects.op11_redirects,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE: dict[str, str] = {"op1_divergence": quality.op1_sql(), "op11_redirects": redirects.op11_sql(), "op12_prefix_trie": trie.op12_sql()}
