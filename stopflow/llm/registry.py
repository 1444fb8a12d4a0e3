"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import ann, bpe, licences, line_dedup, near_dup, packing, quality, secrets, topk, toxicity

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_license_scans": licences.op2_license_scans,
    "op3_approximate_nearest_neighbours": ann.op3_approximate_nearest_neighbours,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_byte_level_bpe": bpe.op5_byte_level_bpe,
    "op6_minhash_near_dedup": near_dup.op6_minhash_near_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {"op2_license_scans": licences.OP2_SQL, "op8_line_dedup": line_dedup.OP8_SQL}
