"""Removal of lines that many sites share, by sketches of the sites of each line.

Every line's sites go into a HyperLogLog sketch; sketches of tasks merge in the aggregation. A line far from
the threshold is judged by its estimate; the sites of lines near it are counted exactly. Lines that reach
the threshold are cross-site boilerplate and leave every text. Lines are compared without white space at
their ends, by two independent hashes (96 bits).

Defined cases: a null text stays null and an empty one empty; blank lines are never removed; lines of a null
site count for no site; repeated rows are cleaned alike; a text may lose all its lines; an empty table gives
an empty table; columns called like the result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HOT, fresh, written

#: log2 of a sketch's registers: a standard error of about 3 %.
REGISTERS = 10
#: Estimates within this share of the threshold, and one at least, are counted exactly: over four errors.
NEAR = 0.15

#: Over how many tasks the copies of a hot text are dealt.
SALTS = 64

_ENDS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_ENDS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g")))


def _keys(text: Column) -> Column:
    return F.transform(_lines(text), _key)


def boilerplate(docs: DataFrame, min_sites: int, site: str = "source", text: str = "text") -> DataFrame:
    """Keys (h, g) of the lines that are on min_sites distinct sites at least."""
    on = docs.select(F.col(f"`{site}`").cast("string").alias("site"), F.explode(F.array_distinct(F.filter(_keys(F.col(f"`{text}`")), lambda k: k.isNotNull()))).alias("k"))
    on = on.where("site IS NOT NULL").select("k.h", "k.g", "site")
    band = max(1.0, NEAR * min_sites)
    spread = written(
        on.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("sites")).where(F.col("sites") >= min_sites - band)
    )
    near = spread.where(F.col("sites") <= min_sites + band).select("h", "g")
    exact = on.join(near, ["h", "g"]).distinct().groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("sites") > min_sites + band).select("h", "g").union(exact.select("h", "g"))


def without_boilerplate(docs: DataFrame, min_sites: int, site: str = "source", text: str = "text", into: str = "lines") -> DataFrame:
    """docs, the text without boilerplate lines, with a struct `into`: n_lines and n_removed.

    What is removed from a text depends on the text alone, so places are found once for each distinct text
    (by its hashes) and joined back; copies of a text that more than one row in HOT has are dealt over tasks.
    """
    shared = written(boilerplate(docs, min_sites, site, text))
    t = F.col(f"`{text}`")
    key = [F.xxhash64(t), F.hash(t), F.length(t)]
    at = docs.where(t.isNotNull()).select(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.posexplode(_keys(t)).alias("p", "k")).select("k0", "k1", "k2", "p", "k.h", "k.g").where("h IS NOT NULL")
    gone = at.join(shared, ["h", "g"], "left_semi").groupBy("k0", "k1", "k2").agg(F.collect_set("p").alias("places"), F.count("*").alias("n"))
    gone = written(gone.withColumn("n", F.expr("n div size(places)")))  # n: the rows that have the text
    rows = gone.agg(F.sum("n")).first()[0] or 0
    hot = gone.where(F.col("n") > rows // HOT).select("k0", "k1", "k2")  # fewer than HOT
    mine = {c: fresh(docs, f"_line_{c}") for c in ("k0", "k1", "k2", "places", "salt", "hot")}
    # copies of a hot text are dealt over SALTS tasks, and its places to each of these
    spread = gone.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["k0", "k1", "k2"], "left")
    spread = spread.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    spread = spread.select(*[F.col(c).alias(mine[c]) for c in ("k0", "k1", "k2", "places", "salt")])
    marked = hot.select(*[F.col(f"k{i}").alias(f"_h{i}") for i in range(3)], F.lit(True).alias(mine["hot"]))
    same = lambda names: reduce(Column.__and__, [k == F.col(n) for k, n in zip(key, names, strict=True)])
    salted = docs.join(F.broadcast(marked), same(["_h0", "_h1", "_h2"]), "left").drop("_h0", "_h1", "_h2")
    dealt = fresh(salted, "_line_dealt")
    salted = salted.withColumn(dealt, F.when(F.col(mine["hot"]), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    joined = salted.join(spread, same([mine["k0"], mine["k1"], mine["k2"]]) & (F.col(dealt) == F.col(mine["salt"])), "left")

    keep = [c for c in docs.columns if c.lower() != into.lower()]
    places = F.col(mine["places"])
    left = F.array_join(F.filter(_lines(t), lambda x, i: ~F.array_contains(places, i)), "\n")
    info = F.struct(F.when(t.isNull(), 0).otherwise(F.size(_lines(t))).cast("bigint").alias("n_lines"), F.when(places.isNull(), 0).otherwise(F.size(places)).cast("bigint").alias("n_removed"))
    return joined.select(*[F.when(places.isNotNull(), left).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in keep], info.alias(into))
