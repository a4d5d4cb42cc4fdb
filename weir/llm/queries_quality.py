"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import RULES, STOP_WORDS, WINDOW, quality_rules
from .shared import table

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *[F.col("quality")[c].alias(c) for c in COLUMNS])


def _sql() -> str:
    per = {
        "n_words": "n_words",
        "mean_word": "word_chars / n_words",
        "symbol_ratio": "n_symbols / n_words",
        "stop_ratio": "n_stop / n_words",
        "upper_ratio": "n_upper / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
    }
    ratio = {k: v if k == "n_words" else f"CASE WHEN {v.split(' / ')[1]} > 0 THEN CAST({v.split(' / ')[0]} AS DOUBLE) / {v.split(' / ')[1]} ELSE 0 END" for k, v in per.items()}
    tests = []
    for r in RULES:
        x = [f"{ratio[r.measure]} < {r.least}"] * (r.least is not None) + [f"{ratio[r.measure]} > {r.most}"] * (r.most is not None)
        tests.append((r.name, f"(({' OR '.join(x)}) AND n_words >= {r.from_words})"))
    base = [("few_words", "(n_words < 10)"), ("repeated_words", "(n_words > 0 AND n_repeat_words * 100 > n_words * 20)")]
    failed = ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in base + tests)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda w: regexp_matches(w, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s
  FROM d, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), again AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS o(k) GROUP BY r
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(again.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop,
         len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w)) AS n_upper
  FROM d LEFT JOIN again USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20 OR {" OR ".join(t for _, t in tests)}) AS kept,
       array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed
FROM m
"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _sql()}
