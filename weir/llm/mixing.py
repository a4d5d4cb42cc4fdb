"""Mixing of sources to target weights by hierarchical budgeting.

Documents are leaves' tokens; leaves hang in a tree (here domain, language, source). A node's budget is
dealt among its children in proportion to their weights, as far as each child's capacity (its tokens times
the epochs allowed) goes; what a short child leaves is dealt among its siblings by the same rule. As a
child's capacity is that of its whole subtree, a shortage reaches an ancestor's siblings only when all
nearer ones are full. All of it is whole-number arithmetic over one row for each node, in windows of a node's
children; tokens that are left over go to the largest remainders, so a budget is met to the token.

A leaf of budget b and t tokens gives b div t whole epochs and a prefix of one more, in which documents lie
in the order of md5(seed:epoch:id). The prefix's last document is found by sums over 4096 ranges of that
order, sixteen at a time, and then within one range, so no leaf, however hot, is ever sorted or summed in one task. Leaves are
broadcast to their documents while they are few; beyond that only hot ones are.

Defined cases: a null path value is a node called "(none)"; a null or empty text has no tokens and is not
drawn; a very long one is one document, which stays whole at the border of a budget; documents of one leaf and id stand at one place and are drawn together; a weight of 0 closes a
subtree; a budget beyond all capacity takes every epoch of everything; an empty table gives an empty table;
columns called like the result are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, joined_evenly, words_of, written

#: Hex digits of the order that make a range: 16**3 ranges.
DIGITS = 3


def word_tokens(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _weight(weights: Mapping[tuple[str, ...], int], path: Sequence[Column]) -> Column:
    """The weight of the node at path; 1 if none is given."""
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1).cast("bigint")
    pairs = [x for k, v in own.items() for x in (F.lit("\x1f".join(k)), F.lit(int(v)).cast("bigint"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\x1f", *path)), F.lit(1).cast("bigint"))


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (weight w, capacity cap, the parent's budget given) with their own budget b."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = group.orderBy(F.col("cap") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = nodes.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    full = full.withColumn("_full", _big(F.col("cap")) * _big(F.col("_w")) <= _big(F.col("w")) * _big(F.col("given") - F.col("_c")))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0))
    rest = F.sum(F.when(~F.col("_full"), F.col("w"))).over(group)
    full = full.withColumn("_left", F.col("given") - taken).withColumn("_rest", rest)
    whole = F.expr("CAST((CAST(w AS DECIMAL(19,0)) * CAST(_left AS DECIMAL(19,0))) DIV CAST(_rest AS DECIMAL(19,0)) AS BIGINT)")
    over = F.expr("(CAST(w AS DECIMAL(19,0)) * CAST(_left AS DECIMAL(19,0))) % CAST(_rest AS DECIMAL(19,0))")
    full = full.withColumn("_b", F.when(F.col("_full"), F.col("cap")).otherwise(whole)).withColumn("_over", F.when(~F.col("_full"), over))
    by_rest = (Window.partitionBy(*parent, "_full") if parent else Window.partitionBy("_full")).orderBy(F.desc("_over"), name)
    more = ~F.col("_full") & (F.row_number().over(by_rest) <= F.col("_left") - F.sum(F.when(~F.col("_full"), F.col("_b"))).over(group))
    return full.withColumn("b", F.col("_b") + F.coalesce(more, F.lit(False)).cast("bigint")).drop("_c", "_w", "_full", "_left", "_rest", "_b", "_over")


def leaf_budgets(leaves: DataFrame, path: list[str], weights: Mapping[tuple[str, ...], int], budget: tuple[int, int] | int, epochs: int) -> DataFrame:
    """leaves (path, tokens) with b: the tokens each is to give. budget: tokens, or a share of all tokens."""
    open_ = F.lit(True)
    for k in range(len(path)):
        open_ = open_ & (_weight(weights, [F.col(c) for c in path[: k + 1]]) > 0)
    leaves = leaves.withColumn("cap", F.when(open_, F.col("tokens") * epochs).otherwise(F.lit(0)).cast("bigint"))
    whole = F.lit(budget).cast("bigint") if isinstance(budget, int) else F.expr(f"CAST((CAST(sum(tokens) AS DECIMAL(19,0)) * {budget[0]}) DIV {budget[1]} AS BIGINT)")
    given = leaves.agg(whole.alias("given"))
    for k in range(len(path)):
        nodes = leaves.groupBy(*path[: k + 1]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("w", F.greatest(_weight(weights, [F.col(c) for c in path[: k + 1]]), F.lit(1).cast("bigint")))
        nodes = nodes.crossJoin(F.broadcast(given)) if k == 0 else nodes.join(given, path[:k])  # one row
        given = _deal(nodes, path[:k], path[k]).select(*path[: k + 1], F.col("b").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "b"), path)


def mix(
    docs: DataFrame, path: Mapping[str, Column], weights: Mapping[tuple[str, ...], int], budget: tuple[int, int] | int,
    epochs: int = 2, seed: int = 0, id: str = "doc_id", tokens: Column | None = None, text: str = "text", into: str = "mix",
) -> DataFrame:
    """docs with a struct `into`: the path, copies (epochs in which the document is drawn) and last_tokens
    (its tokens within the budget in the last of them: fewer than all for the document at the border)."""
    names = list(path)
    nodes = {k: F.coalesce(v.cast("string"), F.lit("(none)")) for k, v in path.items()}
    count = word_tokens(F.col(f"`{text}`")) if tokens is None else tokens
    narrow = written(docs.select(*[v.alias(k) for k, v in nodes.items()], F.col(f"`{id}`").cast("string").alias("id"), count.alias("tokens")))
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).where("tokens > 0")
    budgets = leaf_budgets(leaves, names, weights, budget, epochs)
    leaves = written(budgets.select(*names, F.expr("b DIV tokens").alias("whole"), F.expr("b % tokens").alias("rest"), "rows"))
    place = lambda whole, i: F.md5(F.concat(F.lit(f"{seed}:"), whole.cast("string"), F.lit(":"), F.coalesce(i, F.lit(""))).cast("binary"))
    open_ = leaves.where("rest > 0").withColumnsRenamed({k: f"_{k}" for k in names})
    placed = joined_evenly(narrow.where("tokens > 0"), open_, {f"_{k}": F.col(k) for k in names}, "rows").drop(*open_.columns[: len(names)])
    placed = placed.withColumn("place", place(F.col("whole"), F.col("id"))).withColumn("range", F.substring("place", 1, DIGITS))
    sums = written(placed.groupBy(*names, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest")))
    border = None
    for digits in range(1, DIGITS + 1):  # the border's range, a digit at a time: a leaf has 16 rows in each step
        within = sums.withColumn("before", F.lit(0).cast("bigint")) if border is None else sums.withColumn("head", F.substring("range", 1, digits - 1)).join(border, [*names, "head"]).drop("head")
        by = within.groupBy(*names, F.substring("range", 1, digits).alias("head")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        w = Window.partitionBy(*names).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        by = by.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        border = by.where("before < rest AND rest <= before + n").select(*names, "head", "before")
    border = border.withColumnRenamed("head", "range")
    inner = placed.join(border, [*names, "range"]).groupBy(*names, "range", "place").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    w = Window.partitionBy(*names, "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = inner.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0))).where("start < rest")
    last = last.groupBy(*names).agg(F.max(F.struct("place", "start")).alias("last"))
    cut = leaves.join(last, names, "left")

    own = {k: fresh(docs, f"_mix_{k}") for k in [*names, "whole", "rest", "last", "rows"]}
    cut = cut.select(*[F.col(k).alias(own[k]) for k in own])
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    here = fresh(docs, "_mix_here")
    # the counts are needed once more only to say what the border document gives
    joined = docs.withColumn(here, F.struct(*[v.alias(k) for k, v in nodes.items()], count.alias("tokens"), F.col(f"`{id}`").cast("string").alias("id")))
    at = F.col(here)
    joined = joined_evenly(joined, cut, {own[k]: at[k] for k in names}, own["rows"], "left")
    whole, rest, last = F.coalesce(F.col(own["whole"]), F.lit(0)), F.col(own["rest"]), F.col(own["last"])
    p = place(whole, at["id"])
    drawn = F.coalesce((at["tokens"] > 0) & (p <= last["place"]), F.lit(False))
    copies = F.when(at["tokens"] > 0, whole + drawn.cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    final = F.when(drawn, F.when(p == last["place"], F.least(at["tokens"], rest - last["start"])).otherwise(at["tokens"])).otherwise(F.when(copies > 0, at["tokens"]).otherwise(F.lit(0)))
    return joined.select(*keep, F.struct(*[at[k].alias(k) for k in names], at["tokens"].alias("tokens"), copies.alias("copies"), final.cast("bigint").alias("last_tokens")).alias(into))
