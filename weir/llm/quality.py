"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Defined cases: a null or blank text has no words, so every count is 0 and it fails; repeated rows
are judged alike, each on its own, ties with a threshold pass; a very long text is one row, judged whole; a null in
another column changes nothing, and its name may be any; an empty table gives an empty table. A column of the input that is called as the result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, words_of

SYMBOLS = "#*$%&|<>"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from have in is it of on or that the this to was were with "
    "das den der des die ein eine im in ist mit nicht und von zu "
    "dans de des du en est et la le les pas pour que qui sur un une "
    "con del el en es la las los no para por que se su un una y"
).split()

#: Words of a window; a window found twice makes its words repeated ones.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A text is kept if measure is in [least, most]; texts of fewer than from_words words pass."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The base rules come first. A percentage is one division of whole numbers, so it passes its threshold exactly when
#: the whole numbers do.
BASE = (
    Rule("few_words", "n_words", least=10),
    Rule("repeated_words", "repeat_percent", most=20),
)
RULES = (
    Rule("mean_word_length", "mean_word", least=2, most=15),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02, from_words=40),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("shouting", "upper_ratio", most=0.3, from_words=10),
)


def _per(count: Column, of: Column) -> Column:
    return F.when(of > 0, count.cast("double") / of).otherwise(F.lit(0.0))


def _measures(m: dict[str, Column]) -> dict[str, Column]:
    """What rules may name, from counts."""
    return {
        "n_words": m["n_words"],
        "mean_word": _per(m["word_chars"], m["n_words"]),
        "symbol_ratio": _per(m["n_symbols"], m["n_words"]),
        "stop_ratio": _per(m["n_stop"], m["n_words"]),
        "upper_ratio": _per(m["n_upper"], m["n_words"]),
        "dup_line_ratio": _per(m["n_dup_lines"], m["n_lines"]),
        "repeat_percent": _per(m["n_repeat_words"] * 100, m["n_words"]),
    }


def _fails(rule: Rule, m: dict[str, Column], n_words: Column) -> Column:
    x = m[rule.measure]
    out = F.lit(False)
    if rule.least is not None:
        out = out | (x < rule.least)
    if rule.most is not None:
        out = out | (x > rule.most)
    return out & (n_words >= rule.from_words) if rule.from_words else out


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """docs with a struct column `into`: counts, base_failed, failed (the names of broken rules) and kept.

    Windows are first compared by their hashes; only a text in which two hashes are equal sorts its
    windows as text, so the count is exact. All steps stay within a row: there is no shuffle.
    """
    mine = {k: fresh(docs, f"_q_{k}") for k in ("words", "lines", "hashes", "sorted", "at")}
    words, lines, hashes, placed, at = (F.col(f"`{v}`") for v in mine.values())
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]

    n = F.size(words)
    spans = lambda of: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), of)
    step = docs.withColumn(mine["words"], words_of(F.col(f"`{text}`"))).withColumn(
        mine["lines"], F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    step = step.withColumn(
        mine["hashes"],
        F.when(n >= WINDOW, spans(lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    step = step.withColumn(
        mine["sorted"],
        F.when(
            repeated,
            F.array_sort(spans(lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("s"), i.alias("i")))),
        ),
    )
    near = lambda k: F.get(placed, k)["s"]
    step = step.withColumn(
        mine["at"],
        F.array_sort(
            F.transform(
                F.filter(placed, lambda p, k: F.coalesce(near(k - 1) == p["s"], F.lit(False)) | F.coalesce(near(k + 1) == p["s"], F.lit(False))),
                lambda p: p["i"],
            )
        ),
    )
    n_at = F.size(at)
    covered = F.when(
        F.coalesce(n_at, F.lit(0)) > 0,
        F.aggregate(
            F.zip_with(F.slice(at, F.lit(1), n_at - 1), F.slice(at, F.lit(2), n_at - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))),
            F.lit(WINDOW).cast("bigint"),
            lambda a, x: a + x,
        ),
    ).otherwise(F.lit(0).cast("bigint"))
    bare = F.when(body.rlike(f"[{SYMBOLS}]"), F.octet_length(body) - F.octet_length(F.translate(body, SYMBOLS, ""))).otherwise(F.lit(0))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": bare,
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_upper": F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w))),
    }
    counted = fresh(docs, "_q_counts")
    # one row for one: a filter on the verdict must not be moved below, where it would count all again for each word
    step = step.select(*keep, F.explode(F.array(F.struct(*[v.cast("bigint").alias(k) for k, v in counts.items()]))).alias(counted))
    m = {k: F.col(f"`{counted}`")[k] for k in counts}
    measures = _measures(m)
    base = reduce(Column.__or__, [_fails(r, measures, m["n_words"]) for r in BASE])
    broken = F.filter(
        F.array(*[F.when(_fails(r, measures, m["n_words"]), F.lit(r.name)) for r in BASE + tuple(rules)]),
        lambda x: x.isNotNull(),
    )
    kept = ~base
    for r in rules:
        kept = kept & ~_fails(r, measures, m["n_words"])
    return step.select(
        *keep,
        F.struct(*[m[k].alias(k) for k in counts], base.alias("base_failed"), F.array_join(broken, ",").alias("failed"), kept.alias("kept")).alias(into),
    )
