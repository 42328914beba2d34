"""Operators for preparing large text corpora. Nothing else in the library imports this subpackage."""

from . import elkan_clusters, filter_audit, hamming_topk, html_text, language_profiles, licence_scan, mixing, near_dedup, packing, quality_rules, suffix_dedup, toxicity, url_rules

MODULES = (mixing, hamming_topk, packing, html_text, toxicity, near_dedup, language_profiles, licence_scan, url_rules, quality_rules, filter_audit, suffix_dedup, elkan_clusters)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
