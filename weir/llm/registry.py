"""The queries of the ten operators over the test tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_bilinear, queries_decontaminate, queries_lines, queries_mixing, queries_pii, queries_quality, queries_simhash, queries_tokens, queries_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _of in (queries_pii, queries_bilinear, queries_lines, queries_simhash, queries_tokens, queries_mixing, queries_decontaminate, queries_toxicity, queries_quality):
    QUERIES |= _of.QUERIES
    ORACLES |= _of.ORACLES
