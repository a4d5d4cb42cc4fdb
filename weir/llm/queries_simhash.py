"""Query of SimHash near-dedup. Its fingerprints need XXH64, which DuckDB lacks: tested by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .simhash import near_duplicates


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"), "copies")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES: dict[str, str] = {}
