"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import ann, bpe, decontaminate, license_scan, line_dedup, ngram_join, pii, quality, rindex_dedup, toxicity

QUERIES = {
    "op1_rindex_dedup": rindex_dedup.op1_rindex_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_permutation_ann": ann.op6_permutation_ann,
    "op7_pii": pii.op7_pii,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": license_scan.scan_sql()}
