"""Queries and oracle SQL of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query and the module that has it.
_QUERIES = {
    "op1_mix_sources": "mixing",
    "op2_line_dedup": "line_dedup",
    "op3_quality_classifier": "quality_model",
    "op4_token_counts": "token_counts",
    "op5_warc": "warc",
    "op6_html_extraction": "html_extract",
    "op7_simhash_near_dedup": "near_dedup",
    "op8_avi_media": "media",
    "op9_quality_rules": "quality_rules",
    "op10_best_fit_packing": "packing",
}


def _query(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, module) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
