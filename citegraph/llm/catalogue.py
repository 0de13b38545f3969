"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    bisector, brown, covering, decontaminate, exact_dedup, html_text, mixing, near_join, quality, repair, repeats, token_counts, toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_html_text": html_text.op4_html_text,
    "op5_near_join": near_join.op5_near_join,
    "op6_brown": brown.op6_brown,
    "op7_repeats": repeats.op7_repeats,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_repair": repair.op11_repair,
    "op12_bisector": bisector.op12_bisector,
    "op13_simhash": covering.op13_simhash,
}
ORACLES = {"op8_exact_dedup": exact_dedup.ORACLE, "op11_repair": repair.ORACLE, "op12_bisector": bisector.ORACLE}
