"""Query of the mixing to target weights, and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import mix
from .shared import table

#: Domains of the test sources, by the number in their name.
DOMAINS = (("web", 10), ("books", 15), ("reference", None))
WEIGHTS = {
    ("web",): 50, ("books",): 30, ("reference",): 20,
    ("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 1, ("web", "es"): 1,
    ("books", "en"): 4, ("books", "de"): 3, ("books", "fr"): 2, ("books", "es"): 1,
    ("web", "en", "src0"): 2,
}
SHARE = (7, 10)
EPOCHS = 2
SEED = 17


def path() -> dict[str, Column]:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src([0-9]{1,6})$", 1).try_cast("int")
    domain = F.when(number < DOMAINS[0][1], DOMAINS[0][0]).when(number < DOMAINS[1][1], DOMAINS[1][0]).otherwise(DOMAINS[2][0])
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame, into: str = "mix") -> DataFrame:
    return mix(docs, path(), WEIGHTS, SHARE, epochs=EPOCHS, seed=SEED, into=into)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", *[F.col("mix")[c].alias(c) for c in ("domain", "lang", "source", "tokens", "copies", "last_tokens")])


def _sql() -> str:
    levels = ["domain", "lang", "source"]

    def weight(n: int) -> str:
        own = {k: v for k, v in WEIGHTS.items() if len(k) == n}
        test = " ".join("WHEN " + " AND ".join(f"{c} = '{x}'" for c, x in zip(levels, k, strict=False)) + f" THEN {v}" for k, v in own.items())
        return f"CASE {test} ELSE 1 END" if own else "1"

    steps = []
    for n in (1, 2, 3):
        on, up = ", ".join(levels[:n]), ", ".join(levels[: n - 1])
        part = f"PARTITION BY {up}" if up else ""
        source = f"given0, (SELECT {on}, sum(cap) AS cap FROM leaves GROUP BY {on})" if n == 1 else f"(SELECT {on}, sum(cap) AS cap FROM leaves GROUP BY {on}) JOIN given{n - 1} USING ({up})"
        steps.append(f"""
nodes{n} AS (
  SELECT {on}, CAST(cap AS HUGEINT) AS cap, CAST({weight(n)} AS HUGEINT) AS w, CAST(given AS HUGEINT) AS given FROM {source}
), ranked{n} AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS c, sum(w) OVER ({part}) - coalesce(sum(w) OVER before, 0) AS v FROM nodes{n}
  WINDOW before AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {levels[n - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged{n} AS (
  SELECT *, cap * v <= w * (given - c) AS filled FROM ranked{n}
), shared{n} AS (
  SELECT *, CAST(given - coalesce(sum(cap) FILTER (WHERE filled) OVER ({part}), 0) AS HUGEINT) AS room, CAST(sum(w) FILTER (WHERE NOT filled) OVER ({part}) AS HUGEINT) AS parts FROM judged{n}
), floors{n} AS (
  SELECT *, CASE WHEN filled THEN cap ELSE w * room // parts END AS b, CASE WHEN NOT filled THEN w * room % parts END AS over_ FROM shared{n}
), given{n} AS (
  SELECT {on}, b + CASE WHEN NOT filled AND row_number() OVER (PARTITION BY {up + ", " if up else ""}filled ORDER BY over_ DESC, {levels[n - 1]}) <= room - sum(b) FILTER (WHERE NOT filled) OVER ({part}) THEN 1 ELSE 0 END AS given
  FROM floors{n}
)""")
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CASE WHEN n < {DOMAINS[0][1]} THEN '{DOMAINS[0][0]}' WHEN n < {DOMAINS[1][1]} THEN '{DOMAINS[1][0]}' ELSE '{DOMAINS[2][0]}' END AS domain, tokens
  FROM (SELECT *, try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,6}})$', 1) AS INT) AS n,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tokens FROM documents) AS x
), leaves AS (
  SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL HAVING sum(tokens) > 0
), given0 AS (
  SELECT CAST(sum(tokens) AS HUGEINT) * {SHARE[0]} // {SHARE[1]} AS given FROM leaves
), {",".join(steps)}, budgets AS (
  SELECT domain, lang, source, CAST(given AS BIGINT) // CAST(tokens AS BIGINT) AS whole, CAST(given AS BIGINT) % CAST(tokens AS BIGINT) AS rest FROM leaves JOIN given3 USING (domain, lang, source)
), placed AS (
  SELECT *, md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM d JOIN budgets USING (domain, lang, source)
), run AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start FROM placed
), chosen AS (SELECT *, tokens > 0 AND start < rest AS drawn FROM run)
SELECT doc_id, domain, lang, source, tokens, CASE WHEN tokens > 0 THEN whole + CAST(drawn AS BIGINT) ELSE 0 END AS copies,
       CAST(CASE WHEN drawn THEN least(tokens, rest - start) WHEN tokens > 0 AND whole > 0 THEN tokens ELSE 0 END AS BIGINT) AS last_tokens
FROM chosen
UNION ALL
SELECT doc_id, domain, lang, source, tokens, 0, 0 FROM d ANTI JOIN budgets USING (domain, lang, source)
"""


QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": _sql()}
