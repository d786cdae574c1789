"""The corpus queries registered with the driver, and their DuckDB counterparts."""

from __future__ import annotations

from sparktl.llm import balltree, bitplane, language, lexical, minhash, mixing, nearest, packing, prefix_trie, quality, secret_scan, toxicity, url_filter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_secret_scans": secret_scan.op2_secret_scans,
    "op3_nearest": nearest.op3_nearest,
    "op4_token_planes": bitplane.op4_token_planes,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_minhash": minhash.op8_minhash,
    "op9_language": language.op9_language,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_exact_topk": balltree.op11_exact_topk,
    "op12_lexical": lexical.op12_lexical,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op1_quality_rules": quality.oracle(),
    "op6_mixing": mixing.oracle(),
    "op7_url_filters": url_filter.oracle(),
    "op8_minhash": minhash.oracle(),
    "op11_exact_topk": balltree.oracle(),
    "op12_lexical": lexical.oracle(),
    "op13_prefix_trie": prefix_trie.oracle(),
}
