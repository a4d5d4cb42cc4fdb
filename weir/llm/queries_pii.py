"""Query of the surrogates. DuckDB has no lookbehind patterns: tested by a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import surrogates
from .shared import table

KEY = "weir-surrogates-1"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return found.select("doc_id", "text", "pii.n_entities", F.array_join("pii.kinds", ",").alias("kinds"))


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates}
ORACLES: dict[str, str] = {}
