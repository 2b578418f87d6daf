"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, html_text, language_id, licenses, near_dedup, quality, suffix_dedup, topk, url_filters, vector_codes, warc

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_language_id": language_id.op2_language_id,
    "op3_bpe": bpe.op3_bpe,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_warc": warc.op7_warc,
    "op8_html_text": html_text.op8_html_text,
    "op9_near_duplicates": near_dedup.op9_near_duplicates,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_quality": quality.op12_quality,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op10_exact_topk": topk.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
