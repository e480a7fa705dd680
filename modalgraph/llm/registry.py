"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, checking_sql, lattice_lm, licenses, near_dups, order_minhash, packing, quality_classifier, quality_rules, token_files, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op10_licenses": licenses.op10_licenses,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_token_files": token_files.op3_token_files,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_near_dups": near_dups.op5_near_dups,
    "op6_lattice_lm": lattice_lm.op6_lattice_lm,
    "op7_order_minhash": order_minhash.op7_order_minhash,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": checking_sql.url_filters_sql(),
    "op10_licenses": checking_sql.licenses_sql(),
}
