"""Query of the language-model scores. A trained model is not SQL: tested by brute force and against the base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bilinear import score
from .shared import crc32_of, table


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, docs.where(F.coalesce(crc32_of("doc_id"), F.lit(0)) % 7 != 2)).withColumnRenamed("id", "doc_id")
    held_out = F.coalesce(crc32_of("doc_id"), F.lit(0)) % 7 == 2
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_language_model": op2_language_model}
ORACLES: dict[str, str] = {}
