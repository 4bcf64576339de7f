"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from logscope.llm import (
    byte_bpe,
    conversations,
    fingerprints,
    lines,
    minhash,
    neighbours,
    packing,
    quality,
    repeats,
    secrets,
    toxicity,
    urls,
    vector_codes,
)

QUERIES = {
    "op1_quality_rules": (quality.op1, quality.OP1_SQL),
    "op2_secret_scans": (secrets.op2, secrets.OP2_SQL),
    "op3_mixture_packing": (packing.op3, None),
    "op4_byte_bpe": (byte_bpe.op4, None),
    "op5_repeated_substrings": (repeats.op5, None),
    "op6_url_filters": (urls.op6, None),
    "op7_line_dedup": (lines.op7, lines.OP7_SQL),
    "op8_toxicity": (toxicity.op8, None),
    "op9_nearest_neighbours": (neighbours.op9, neighbours.OP9_SQL),
    "op10_minhash_near_dedup": (minhash.op10, None),
    "op11_vector_codes": (vector_codes.op11, None),
    "op12_document_fingerprints": (fingerprints.op12, None),
    "op13_conversation_repair": (conversations.op13, None),
}
