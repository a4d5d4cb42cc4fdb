import random
import re

from weir.llm import decontaminate as d


def brute(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = find(text), set(), set()
    for name, t in items:
        w = find(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    if name is not None:
                        ids.add(str(name))
    return len(words), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(words)


def case(rng):
    letters = "ab" if rng.random() < 0.5 else "abcdefgh"
    items = [(rng.choice([None, rng.randrange(30)]) if rng.random() < 0.2 else k, rng.choice([" ", ", "]).join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for k in range(8)]
    texts = []
    for _ in range(12):
        t = rng.choices(letters + "xyz", k=rng.randrange(60))
        for _, i in rng.sample(items, 2):
            at = rng.randrange(len(t) + 1)
            t[at:at] = i.replace(",", "").upper().split()
        texts.append("-".join(t))
    return items, texts


def test_equals_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        items, texts = case(rng)
        rows = [(i, t, "x") for i, t in enumerate([*texts, None, "", "!!", "é" * 40_000])]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, leak string")
        got = d.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
        for r in got.collect():
            assert (r.leak.n_words, r.leak.n_hit, r.leak["items"], r.leak.contaminated) == brute(r.text, items)
            if r.text is not None:
                assert r.leak.n_hit == sum(s.end - s.start for s in r.leak.spans)
                assert len(d.words_of_item(r.leak.clean_text.encode())) >= r.leak.n_words - r.leak.n_hit - len(r.leak.spans)


def test_many_automata_find_what_one_finds(spark, monkeypatch):
    items, texts = case(random.Random(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(str, d.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(d, "AUTOMATON_BYTES", 150)
    assert len(d.automata(bench)) > 1
    assert sorted(map(str, d.decontaminate(docs, bench).collect())) == one


def test_removal_leaves_the_rest(spark):
    item = " ".join(f"w{i}" for i in range(15))
    text = f"Before it. {item.upper()}! After"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = d.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).first().leak
    assert got.clean_text == "Before it. ! After" and got["items"] == ["7"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.decontaminate(docs, none).first().leak.n_words == 2
    assert d.decontaminate(docs.limit(0), none).count() == 0
