import random

from weir.llm.lines import without_boilerplate


def brute(rows, least):
    bare = lambda x: x.strip(" \t\n\r\x0b\x0c")
    sites: dict[str, set] = {}
    for _, site, text in rows:
        for x in (text or "").split("\n"):
            if bare(x) and site is not None:
                sites.setdefault(bare(x), set()).add(site)
    gone = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, _, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
        else:
            own = text.split("\n")
            left = [x for x in own if bare(x) not in gone]
            out.append((i, "\n".join(left), len(own), len(own) - len(left)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    lines = [f"line {k}" for k in range(40)] + ["", "  ", " line 1\t", "é"]
    for least in (1, 3, 12):
        rows = [(i, rng.choice([None, *map(str, range(20))]), "\n".join(rng.choices(lines, weights=[1 / (k + 1) for k in range(len(lines))], k=rng.randrange(6)))) for i in range(80)]
        rows += [(100, "3", None), (101, "3", ""), (101, "3", ""), (102, None, "line 0"), (103, "5", "long " * 20_000 + "\nline 0")]
        docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS lines", "'z' AS h")
        got = without_boilerplate(docs, least).collect()
        assert sorted([(r.doc_id, r.text, r.lines.n_lines, r.lines.n_removed) for r in got], key=str) == brute(rows, least)


def test_many_sites_beyond_the_band(spark):
    rows = [(i, f"s{i}", "shared everywhere\nown %d\n%s" % (i, "half" if i % 2 else "other")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id: r.text for r in without_boilerplate(docs, 150).collect()}
    assert got == {i: f"own {i}" for i in range(300)}
    assert without_boilerplate(docs.limit(0), 3).count() == 0


def test_copies_of_a_hot_text_are_dealt_over_tasks(spark, monkeypatch):
    import weir.llm.lines as m

    monkeypatch.setattr(m, "HOT", 4)
    rows = [(i, f"s{i % 9}", "hot line\nthe same in all\nhot line") for i in range(200)] + [(200 + i, f"s{i}", f"hot line\nown {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS `a.b`", "2 AS salt", "3 AS k0").repartition(7)
    got = without_boilerplate(docs, 9)
    assert got.columns == ["doc_id", "source", "text", "a.b", "salt", "k0", "lines"]
    got = got.collect()
    assert sorted([(r.doc_id, r.text, r.lines.n_lines, r.lines.n_removed) for r in got], key=str) == brute(rows, 9)
    assert {r.text for r in got if r.doc_id < 200} == {""}
