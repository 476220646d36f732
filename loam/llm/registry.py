"""The corpus operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import canonical, embedding_graph, html_render, jaccard_join, mixing, packing, paragraph_dedup, pii, toxicity, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mix_pfair": mixing.op2_mix_pfair,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_embedding_graph": embedding_graph.op4_embedding_graph,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_text": html_render.op6_html_text,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_canonical_digest": canonical.op8_canonical_digest,
    "op9_paragraph_dedup": paragraph_dedup.op9_paragraph_dedup,
    "op10_best_fit": packing.op10_best_fit,
}

ORACLES: dict[str, str] = {
    "op2_mix_pfair": mixing.ORACLE,
    "op4_embedding_graph": embedding_graph.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
}
