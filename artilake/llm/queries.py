"""The queries of the training-data operators, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, lm, media, ngram_join, packing, secrets, substrings, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = [toxicity.op1_counterfactual_toxicity, media.op2_media_archives, substrings.op3_suffix_array_dedup, lm.op4_deleted_interpolation, secrets.op5_secret_ownership, token_files.op6_rans_token_files, decontaminate.op7_qgram_decontamination, language.op8_compression_language, ngram_join.op9_vertical_ngram_join, packing.op10_power_of_two_packing]
    return {f.__name__: f for f in out}


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_ownership": secrets.ORACLE}
