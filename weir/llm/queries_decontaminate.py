"""Query of benchmark decontamination, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import WINDOW, decontaminate, items_digest
from .shared import table


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], clean=False)
    x = F.col("leak")
    return found.select("doc_id", x.n_words.alias("n_words"), x.n_hit.alias("n_hit"), F.size(x["items"]).cast("bigint").alias("n_items"), items_digest(x["items"]).alias("items_sha256"), x.contaminated.alias("contaminated"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), found AS (
  SELECT r, i, n, item_id
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM items) AS k, unnest(range(1, len(w) - n + 2)) AS t(i)) AS x
  JOIN items USING (n, s)
), hits AS (
  SELECT r, count(DISTINCT i + o) AS n_hit FROM found, unnest(range(n)) AS t(o) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) AS x GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
ORACLES = {"op7_benchmark_decontamination": SQL}
