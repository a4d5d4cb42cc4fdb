"""Query of the line dedup, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import without_boilerplate
from .shared import table

MIN_SITES = 8


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIN_SITES)
    return found.select("doc_id", "lines.n_lines", "lines.n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (
  SELECT r, source, p, x, regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d WHERE text IS NOT NULL) AS y
), b AS (
  SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}
), c AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE b.bare IS NOT NULL) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE b.bare IS NULL), '') AS text
  FROM l LEFT JOIN b USING (bare) GROUP BY r
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(c.text) AS text_md5 FROM d LEFT JOIN c USING (r)
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": SQL}
