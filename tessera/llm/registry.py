"""The training-data queries by name, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, html_text, language, licenses, line_dedup, near_dup, quality_model, quality_rules, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licences": licenses.op1_licences, "op2_near_dup": near_dup.op2_near_dup, "op3_bpe": bpe.op3_bpe, "op4_line_dedup": line_dedup.op4_line_dedup, "op5_quality_rules": quality_rules.op5_quality_rules, "op6_quality": quality_model.op6_quality, "op7_language": language.op7_language, "op8_html": html_text.op8_html, "op9_decontaminate": decontaminate.op9_decontaminate, "op10_token_store": token_store.op10_token_store}


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": licenses.OP1_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
