"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language_id, line_dedup, mixing, near_dedup, periodic_runs, secret_scan, spotsigs, token_files, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_url_filters": url_filter.op2_url_filters,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_token_output": token_files.op5_token_output,
        "op6_mixing": mixing.op6_mixing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_language_id": language_id.op9_language_id,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_document_fingerprints": spotsigs.op13_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filter.ORACLE_OP2, "op7_line_dedup": line_dedup.ORACLE_OP7, "op8_decontamination": decontaminate.ORACLE_OP8}
