"""The training-data queries and their SQL."""

from __future__ import annotations

from cellweave.llm import bpe, exact_dedup, fingerprints, html_text, language, line_dedup, mixing, quality, simhash, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        line_dedup.op2_line_dedup,
        fingerprints.op3_fingerprints,
        toxicity.op4_toxicity,
        language.op5_language,
        simhash.op6_simhash_near_dedup,
        exact_dedup.op7_exact_dedup,
        bpe.op8_byte_bpe,
        mixing.op9_mix_sources,
        html_text.op10_html_text,
    )
}

SQL = {"op2_line_dedup": line_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op9_mix_sources": mixing.SQL}
