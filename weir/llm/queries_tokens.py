"""Queries of token counts and token files. SQL has no tokenizer: tested against the tokenizers library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .rank_bpe import token_counts
from .shared import table
from .token_files import write_and_digest

END = 2


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048, keep=["doc_id"])
    return found.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit")


def token_files(docs: DataFrame) -> DataFrame:
    found = write_and_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), end=END)
    return found.selectExpr("id AS doc_id", "start", "n AS n_tokens", "crc AS ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_files": op5_token_files, "op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
