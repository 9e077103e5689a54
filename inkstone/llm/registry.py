"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from inkstone.llm import audit, decontaminate, embeddings, html, language, minhash, mixing, packing, quality, secrets, sessions, tokencounts, toxicity


def queries() -> dict:
    found = (
        minhash.op1_minhash_near_dedup,
        decontaminate.op2_benchmark_decontamination,
        html.op3_html_extraction,
        mixing.op4_source_mixing,
        secrets.op5_secret_scan,
        quality.op6_quality_classifier,
        embeddings.op7_embedding_near_dedup,
        language.op8_language_id,
        packing.op9_token_packing,
        toxicity.op10_toxicity,
        tokencounts.op11_token_counts,
        sessions.op12_session_merging,
        audit.op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": minhash.OP1_SQL,
        "op2_benchmark_decontamination": decontaminate.OP2_SQL,
        "op5_secret_scan": secrets.OP5_SQL,
        "op7_embedding_near_dedup": embeddings.OP7_SQL,
        "op12_session_merging": sessions.OP12_SQL,
        "op13_filter_audit": audit.OP13_SQL,
    }
