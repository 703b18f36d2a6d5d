"""Queries and SQL of the text operators."""

from __future__ import annotations

from . import ann, decontaminate, license_scan, line_dedup, lm, mixing, quality, simhash, substring_dedup, toxicity
from .common import Query

QUERIES: dict[str, Query] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_lm_score": lm.op8_lm_score,
    "op9_quality": quality.op9_quality,
    "op10_nearest": ann.op10_nearest,
}

SQL: dict[str, str] = {
    "op1_license_scan": license_scan.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op5_mix_sources": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
}
