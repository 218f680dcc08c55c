"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, mixing, packing, pii, quality, secrets, sharding, simhash, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_pii": pii.op6_pii,
    "op7_embedding_near_dedup": embed_dedup.op7_embedding_near_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_sharding": sharding.op10_sharding,
}

SQL: dict[str, str] = {"op5_quality_rules": quality.OP5_SQL, "op8_mixing": mixing.OP8_SQL}
