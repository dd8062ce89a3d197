"""Queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gazetta.llm import contracts, sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_fourier_quality": contracts.quality_scores,
    "op2_bootstrapped_pii": contracts.personal_data,
    "op3_ownership_secrets": contracts.secret_spans,
    "op4_license_digests": contracts.license_digests,
    "op5_recurrent_blocks": contracts.main_text,
    "op6_superminhash_near_dedup": contracts.near_dedup,
    "op7_spaced_seed_decontamination": contracts.benchmark_overlaps,
    "op8_exact_top_k": contracts.nearest_vectors,
    "op9_residual_packing": contracts.packed,
    "op10_byte_gru_language": contracts.languages,
    "op11_vantage_point_simhash": contracts.fingerprint_dedup,
    "op12_transducer_divergence": contracts.divergence,
    "op13_hilbert_zone_clusters": contracts.centroid_clusters,
}

SQL: dict[str, str] = {
    "op3_ownership_secrets": sql.SECRETS,
    "op4_license_digests": sql.LICENSES,
    "op6_superminhash_near_dedup": sql.NEAR_DEDUP,
    "op8_exact_top_k": sql.TOP_K,
    "op12_transducer_divergence": sql.DIVERGENCE,
    "op13_hilbert_zone_clusters": sql.CLUSTERS,
}
