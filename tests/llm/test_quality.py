import random
import re

from weir.llm.quality import SYMBOLS, quality_rules


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at: dict[tuple, list] = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a b c d e a b c d e", "x " * 30, "the " * 4, "A\x1cb c\x85d", "#$%&|<>*", "w " * 20_000, "é\n\né\n é"]
    texts += [rng.choice(["", " ", "\n"]).join([rng.choice("ab ") + rng.choice([" ", "\n", "\t", "", "# "]) for _ in range(rng.randrange(80))]) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    for r in quality_rules(docs).collect():
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(r.text), repr(r.text)
        assert q.kept == (q.failed == "") and not (q.kept and q.base_failed)


def test_verdicts_native_plan_and_empty_table(spark):
    good = "The house is in the north of the town and it was built by the river for a family that was there before them"
    docs = spark.createDataFrame([(1, good), (2, good.upper()), (3, good.replace(" ", "# ")), (4, "tiny text")], "doc_id bigint, text string")
    got = {r.doc_id: r.quality for r in quality_rules(docs).where("quality.kept OR true").collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and got[4].failed.startswith("few_words")
    plan = quality_rules(docs).where("quality.kept")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality_rules(docs.limit(0)).count() == 0
