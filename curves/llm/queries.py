"""The operators' queries and their oracles."""

from __future__ import annotations

from curves.llm import bottom_k, html_main, line_dedup, merkle, minhash, mixing, packing, quality_fm, quality_rules, resampling, revisits, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_revisits": revisits.op2_revisits,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_packing": packing.op5_packing,
    "op6_minhash": minhash.op6_minhash,
    "op7_quality_fm": quality_fm.op7_quality_fm,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_main": html_main.op9_html_main,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_bottom_k": bottom_k.op11_bottom_k,
    "op12_resampling": resampling.op12_resampling,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op2_revisits": revisits.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_resampling": resampling.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
