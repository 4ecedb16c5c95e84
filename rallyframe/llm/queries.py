"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, html_text, line_dedup, max_score, paragraph_sketch, secrets, sharding, simhash, spelling, token_store, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_token_store": token_store.op2_token_store,
        "op3_secrets": secrets.op3_secrets,
        "op4_paragraph_sketch": paragraph_sketch.op4_paragraph_sketch,
        "op5_html_text": html_text.op5_html_text,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_simhash": simhash.op10_simhash,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_spelling": spelling.op12_spelling,
        "op13_max_score": max_score.op13_max_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": line_dedup.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
        "op12_spelling": spelling.ORACLE,
        "op13_max_score": max_score.ORACLE,
    }
