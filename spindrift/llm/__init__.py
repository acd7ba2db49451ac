"""Operators of a training-data pipeline. Nothing else in the library imports this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, centroids, chat, linededup, packing, quality, secrets, simhash, substring, toxicity, warc, whitening

_QUERIES = (
    audio.op1_audio_features,
    warc.op3_warc_transactions,
    chat.op4_chat_formatting,
    bpe.op7_bpe_forced_boundaries,
    packing.op8_best_fit_packing,
    linededup.op2_line_dedup,
    toxicity.op5_toxicity,
    simhash.op6_simhash_near_dedup,
    quality.op9_quality_rules,
    secrets.op10_secret_scans,
    centroids.op11_dual_tree_lloyd,
    whitening.op12_embedding_whitening,
    substring.op13_substring_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.OP2_SQL, "op11_dual_tree_lloyd": centroids.OP11_SQL, "op13_substring_dedup": substring.OP13_SQL}
