"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, langid, licenses, mixing, neighbours, packing, pii, quality, sharding, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op2_ngram_jaccard_join": jaccard.query,
    "op3_packing": packing.query,
    "op4_pii": pii.query,
    "op5_language_id": langid.query,
    "op6_mixing": mixing.query,
    "op7_repeated_substrings": substrings.query,
    "op8_sharding": sharding.query,
    "op9_nearest_neighbours": neighbours.query,
    "op10_licenses": licenses.query,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op1_quality_rules": quality.oracle,
    "op2_ngram_jaccard_join": jaccard.oracle,
    "op6_mixing": mixing.oracle,
    "op8_sharding": sharding.oracle,
}
