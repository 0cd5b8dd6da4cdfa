"""The queries and SQL of this subpackage."""

from __future__ import annotations

from tessera.llm import bpe, html, mixing, quality, sharding, simhash, spelling, suffixes, topk, toxicity, tries, urls, vectors

QUERIES = {
    "op1_simhash_dedup": simhash.query,
    "op2_quality_rules": quality.query,
    "op3_topk_search": topk.query,
    "op4_bpe": bpe.query,
    "op5_mixing": mixing.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_url_filter": urls.query,
    "op8_toxicity": toxicity.query,
    "op9_sharding": sharding.query,
    "op10_html_text": html.query,
    "op11_vector_dedup": vectors.query,
    "op12_prefix_trie": tries.query,
    "op13_spelling_variants": spelling.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op3_topk_search": topk.ORACLE_SQL,
    "op6_suffix_dedup": suffixes.ORACLE_SQL,
    "op7_url_filter": urls.ORACLE_SQL,
    "op11_vector_dedup": vectors.ORACLE_SQL,
    "op12_prefix_trie": tries.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
