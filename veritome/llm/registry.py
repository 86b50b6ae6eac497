"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from veritome.llm import decontamination, jaccard_join, lm_scoring, packing, personal_data, quality_classifier, quality_rules, scratch, suffix_dedup, toxicity, url_filters

MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_personal_data": personal_data,
    "op3_jaccard_join": jaccard_join,
    "op4_toxicity": toxicity,
    "op5_packing": packing,
    "op6_suffix_dedup": suffix_dedup,
    "op7_lm_scoring": lm_scoring,
    "op8_url_filters": url_filters,
    "op9_quality_classifier": quality_classifier,
    "op10_decontamination": decontamination,
}


def _bounded(query):
    """A query that also bounds Arrow batches where its rows are computed after it returns."""

    def run(spark, sf_dir):
        scratch.bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _bounded(module.query) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in MODULES.items() if (sql := getattr(module, "ORACLE_SQL", None))}
