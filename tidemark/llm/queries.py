"""The queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    ann, bpe, divergence, embedding_dedup, html_text, lm, mixing, quality, repeats, resampling, sharding, simhash, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_pu": quality.op1_quality_pu,
    "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
    "op3_arc_to_warc": warc.op3_arc_to_warc,
    "op4_ipf_mixing": mixing.op4_ipf_mixing,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_anisotropic_search": ann.op6_anisotropic_search,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_kd_sharding": sharding.op8_kd_sharding,
    "op9_lm_scores": lm.op9_lm_scores,
    "op10_html_main_text": html_text.op10_html_main_text,
    "op11_lpf_repeats": repeats.op11_lpf_repeats,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {"op4_ipf_mixing": mixing.ORACLE, "op12_source_divergence": divergence.ORACLE}
