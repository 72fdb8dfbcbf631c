"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, collocations, exact_dedup, html_text, mixing, near_dedup, near_vectors, periodic_runs, pii, quality, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_bootstrapped_pii": pii.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_source_mixing": mixing.op3,
    "op4_quality_rules": quality.op4,
    "op5_toxicity": toxicity.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_html_text": html_text.op7,
    "op8_byte_bpe": byte_bpe.op8,
    "op9_minhash_near_dedup": near_dedup.op9,
    "op10_url_filter": url_filter.op10,
    "op11_collocations": collocations.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_near_vectors": near_vectors.op13,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
