"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Query name: module that defines a function of that name.
_MODULES = {
    "op1_decontamination": "decontamination",
    "op2_best_fit_packing": "packing",
    "op3_sorted_shards": "sstable",
    "op4_token_counts": "token_counts",
    "op5_simhash": "simhash",
    "op6_quality_rules": "quality_rules",
    "op7_warc": "warc",
    "op8_line_dedup": "line_dedup",
    "op9_html_extraction": "html_extract",
    "op10_quality_classifier": "rule_ensemble",
    "op11_merkle_manifest": "merkle",
    "op12_license_scan": "licenses",
    "op13_source_divergence": "divergence",
}


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""

    def lazily(name: str, module: str):
        return lambda spark, sf_dir: getattr(import_module(f"leafmill.llm.{module}"), name)(spark, sf_dir)

    return {name: lazily(name, module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from leafmill.llm.sql import ORACLES

    return dict(ORACLES)
