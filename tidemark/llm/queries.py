"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, classify, decontaminate, licenses, near_dup, packing, sharding, token_files

_QUERIES = [
    ann.op1_rp_forest,
    classify.op2_quality_compression,
    chat.op3_role_repair,
    token_files.op4_token_files,
    decontaminate.op5_benchmark_leaks,
    classify.op6_toxicity_compression,
    packing.op7_binary_packing,
    near_dup.op8_circulant_minhash,
    licenses.op9_license_scan,
    sharding.op10_external_shuffle,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scan": licenses.op9_sql()}
