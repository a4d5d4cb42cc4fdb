"""Query of the toxicity scores. A trained network is not SQL: tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc32_of, table
from .toxicity import score, train_on


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc32_of("doc_id") % 5 != 0)
    found = score(docs, train_on(docs, labels), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "toxicity.score", "toxicity.predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
