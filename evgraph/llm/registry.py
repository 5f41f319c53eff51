"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, decontaminate, language_id, near_dup, packing, quality, sentencepiece_scan, substring_dedup, url_filter, warc


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_sentencepiece": sentencepiece_scan.op2_sentencepiece,
        "op3_warc": warc.op3_warc,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_near_duplicates": near_dup.op6_near_duplicates,
        "op7_token_packing": packing.op7_token_packing,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_language_id": language_id.op9_language_id,
        "op10_nearest_neighbours": ann.op10_nearest_neighbours,
    }


def oracle_sql() -> dict:
    return {"op3_warc": warc.ORACLE, "op8_url_filter": url_filter.ORACLE}
