import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weir.llm.mixing import mix


def deal(children, given):
    """children: {name: (weight, capacity)}; the same rule, by filling the shortest child first."""
    out, left, rest = {}, given, dict(children)
    while rest:
        total = sum(w for w, _ in rest.values())
        name = min(rest, key=lambda n: (rest[n][1] / rest[n][0], n))
        w, cap = rest[name]
        if Fraction(cap) > Fraction(w * left, total):
            own = {n: divmod(w * left, total) for n, (w, _) in rest.items()}
            more = sorted(own, key=lambda n: (-own[n][1], n))[: left - sum(q for q, _ in own.values())]
            return out | {n: q + (n in more) for n, (q, _) in own.items()}
        out[name] = cap
        left -= cap
        del rest[name]
    return out


def brute(rows, weights, share, epochs, seed):
    """rows: (id, path, tokens). (copies, last_tokens) of each row."""
    weight = lambda p: weights.get(p, 1)
    leaves: dict[tuple, int] = {}
    for _, p, n in rows:
        leaves[p] = leaves.get(p, 0) + n
    leaves = {p: n for p, n in leaves.items() if n}
    caps = {p: n * epochs if all(weight(p[: k + 1]) > 0 for k in range(3)) else 0 for p, n in leaves.items()}
    budgets = {(): sum(leaves.values()) * share[0] // share[1]}
    for k in range(3):
        for up in {p[:k] for p in leaves}:
            own = {}
            for p in {p[: k + 1] for p in leaves if p[:k] == up}:
                own[p] = (max(weight(p), 1), sum(c for q, c in caps.items() if q[: k + 1] == p))
            budgets |= deal(own, budgets[up])
    out = []
    place = {}
    for i, p, n in rows:
        if n:
            whole = budgets[p] // leaves[p]
            place.setdefault(p, {}).setdefault(hashlib.md5(f"{seed}:{whole}:{i if i is not None else ''}".encode()).hexdigest(), []).append(n)
    for i, p, n in rows:
        if not n:
            out.append((i, 0, 0))
            continue
        whole, rest = divmod(budgets[p], leaves[p])
        me = hashlib.md5(f"{seed}:{whole}:{i if i is not None else ''}".encode()).hexdigest()
        start = sum(sum(v) for k, v in place[p].items() if k < me)
        drawn = start < rest
        out.append((i, whole + drawn, min(n, rest - start) if drawn else n if whole else 0))
    return sorted(out, key=str), budgets


def test_equals_brute_force(spark):
    rng = random.Random(7)
    for share, epochs, weights in [((1, 2), 1, {}), ((3, 2), 3, {("a",): 9, ("b",): 1, ("a", "x"): 5, ("a", "x", "s0"): 7}), ((9, 1), 2, {("b", "y"): 0}), ((0, 1), 1, {})]:
        rows = []
        for i in range(300):
            path = (rng.choice("abc"), rng.choice(["x", "x", "x", None]), f"s{rng.choice([0, 0, 0, 1, 2])}")
            rows.append((rng.choice([i, i, i, None, 5]), *path, "w " * rng.choice([0, 1, 7, 50]), "old"))
        docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, text string, mix string")
        got = mix(docs, {"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}, weights, share, epochs=epochs, seed=3).collect()
        plain = [(r[0], (r[1], r[2] or "(none)", r[3]), len(r[4].split())) for r in rows]
        want, budgets = brute(plain, weights, share, epochs, 3)
        assert sorted([(r.doc_id, r.mix.copies, r.mix.last_tokens) for r in got], key=str) == want
        if epochs == 3:
            assert sum(v for k, v in budgets.items() if len(k) == 3) > 0


def test_budgets_are_met_to_the_token(spark):
    rows = [(i, "d", f"l{i % 7}", f"s{i % 3}", "w " * 100) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, text string")
    got = mix(docs, {k: F.col(k) for k in ("domain", "lang", "source")}, {}, 1000, epochs=1).collect()
    assert sum(r.mix.last_tokens for r in got) == 1000


@pytest.mark.parametrize("rows_", [0, 3])
def test_many_leaves_are_joined_alike(spark, monkeypatch, rows_):
    """Beyond the bound on what is broadcast, with a hot leaf and cool ones; columns are called like the join's own."""
    import weir.llm.shared as s

    rows = [(i, "d", "l", "hot" if i % 2 else f"s{i % 40}", "w " * (i % 9), "x", "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, text string, rows string, `_mix_rows` string")
    path = {k: F.col(k) for k in ("domain", "lang", "source")}
    want = sorted(mix(docs, path, {}, (1, 2)).collect())
    monkeypatch.setattr(s, "BROADCAST_ROWS", rows_)
    monkeypatch.setattr(s, "HOT", 10)
    assert sorted(mix(docs, path, {}, (1, 2)).collect()) == want and len(want) == 400


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(1, "a", "x", "s", "w " * 10), (2, "a", "y", "s", "w " * 100), (3, "b", "x", "s", "w " * 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, text string")
    path = {k: F.col(k) for k in ("domain", "lang", "source")}
    got = {r.doc_id: r.mix for r in mix(docs, path, {}, 120, epochs=1).collect()}
    # each domain is to give 60: a's x has 10 of its 30, so a's y gives 50, and b is not asked for more
    assert [got[i].last_tokens for i in (1, 2, 3)] == [10, 50, 60]
    assert mix(docs.limit(0), path, {}, 5).count() == 0
