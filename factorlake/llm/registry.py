"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from factorlake.llm import bpe, filter_audit, langid, licenses, media, mixing, neardup, quality, suffix_dedup, token_files, topk, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
        "op2_media_columns": media.op2_media_columns,
        "op3_bpe": bpe.op3_bpe,
        "op4_exact_top_k": topk.op4_exact_top_k,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_language_id": langid.op6_language_id,
        "op10_quality": quality.op10_quality,
        "op7_mixing": mixing.op7_mixing,
        "op9_minhash_near_dedup": neardup.op9_minhash_near_dedup,
        "op8_license_scans": licenses.op8_license_scans,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": topk.ORACLE, "op7_mixing": mixing.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
