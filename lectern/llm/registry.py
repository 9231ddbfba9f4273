"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import (
    decontaminate,
    fingerprints,
    html,
    language_model,
    licenses,
    ngram_join,
    packing,
    quality,
    secrets,
    token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_pack": packing.op2_pack,
    "op3_lm_scores": language_model.op3_lm_scores,
    "op4_secrets": secrets.op4_secrets,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_html": html.op7_html,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality": quality.op9_quality,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

#: No operator here is in SQL's reach: each is tested against a brute-force version, a round trip or held-out labels.
ORACLES: dict[str, str] = {}
