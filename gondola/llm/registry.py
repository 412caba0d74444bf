"""The operators' queries and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from gondola.llm import oracles, queries_a, queries_b, queries_c, queries_d, queries_e

QUERIES = {
    "op1_line_frequency": queries_c.op1_line_frequency,
    "op2_suffix_dedup": queries_d.op2_suffix_dedup,
    "op3_mixing": queries_b.op3_mixing,
    "op4_secrets": queries_b.op4_secrets,
    "op5_token_files": queries_a.op5_token_files,
    "op6_fingerprints": queries_c.op6_fingerprints,
    "op7_urls": queries_b.op7_urls,
    "op8_language_id": queries_a.op8_language_id,
    "op9_near_duplicates": queries_d.op9_near_duplicates,
    "op10_bpe": queries_a.op10_bpe,
    "op11_collocations": queries_e.op11_collocations,
    "op12_page_text": queries_e.op12_page_text,
    "op13_alignment": queries_e.op13_alignment,
}
ORACLES: dict[str, str] = {
    "op1_line_frequency": oracles.OP1,
    "op3_mixing": oracles.OP3,
    "op4_secrets": oracles.OP4,
    "op7_urls": oracles.OP7,
    "op11_collocations": oracles.OP11,
}
