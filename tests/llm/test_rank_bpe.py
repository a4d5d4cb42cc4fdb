import random

import public_tokenizers
from tokenizers import Tokenizer

import weir.llm.rank_bpe as r

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  \n ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endof text|>", "It's we'LL they'd 'tis can't", "aaaaaaaaaaaaaaaa aaa aaaa",
    "ΟΔΥΣΣΕΥΣ ΣΑΣ Σ.", "école É é", "İstanbul ǅ", "x\x1cy\x85z\xa0w v", "½ ² Ⅷ 一二 123 1_2", "́ a ́", "🙂🙃 naïve—dash … ___ ###", "x" * 30_000, "ha" * 20_000 + " " + "é" * 5000,
]


def test_equals_the_library(spark, monkeypatch):
    rng = random.Random(2)
    letters = "abcdefghijklmnoptuwz éèßñ'.,!<|>#1 \n\t"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 200))) for _ in range(400)]
    lib = Tokenizer.from_file(PATH)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = sorted((x.doc_id, x.tokens.n_bytes, x.tokens.n_tokens) for x in r.token_counts(docs, PATH).collect())
    assert got == want
    small = r.RankCounter(PATH)
    monkeypatch.setattr(r, "TABLE", 50)
    monkeypatch.setattr(r, "BATCH", 40)
    assert [n for k in range(0, len(texts), 25) for n in small.count([t or "" for t in texts[k : k + 25]])] == [w[2] for w in want]


def test_every_character_is_counted_as_the_library_does():
    """Marks behind letters of any script, too: composition must be that of the library's Unicode version."""
    lib = Tokenizer.from_file(PATH)
    own = r.RankCounter(PATH)
    rng = random.Random(6)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x12500 or c % 97 == 0)]
    texts = [" ".join(f"{chr(c)} a{chr(c)}\u0e39 '{chr(c)}{chr(rng.choice(points))}.\u094d" for c in points[k : k + 30]) for k in range(0, len(points), 30)]
    texts += ["\u089a\u0e39", "'\u08cf\u094d", "e\u0301\u0327 \u1e9b\u0323", "\u0130\u03a3 A\u03a3"]
    assert own.count(texts) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]
    assert max(map(len, own.table)) <= r.LONGEST


def test_limit_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.tokens.over_limit) for x in r.token_counts(docs, PATH, limit=2).collect()) == [(1, True), (2, False)]
    assert r.token_counts(docs.limit(0), PATH).count() == 0
