"""The ten queries, and SQL for those that it can express."""

from __future__ import annotations

from cohortgeo.llm import decontaminate, language_id, licenses, nearest, packing, pii, simhash, suffix_dedup, token_counts, url_filter


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            language_id.op1_language_id,
            token_counts.op2_token_counts,
            suffix_dedup.op3_suffix_dedup,
            decontaminate.op4_benchmark_decontamination,
            nearest.op5_nearest_neighbours,
            simhash.op6_simhash,
            pii.op7_pii,
            url_filter.op8_url_filter,
            packing.op9_best_fit_packing,
            licenses.op10_license_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": suffix_dedup.ORACLE, "op10_license_scan": licenses.oracle()}
