"""The whole pipeline against brute force, stage by stage, on a small table with planted cases."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from tests.llm import test_decontaminate, test_mixing, test_quality, test_simhash
from weir.llm.queries_mixing import EPOCHS, SEED, SHARE, WEIGHTS
from weir.llm.shared import written

STOP = "the of and to in is"


def tables(spark, folder):
    rng = random.Random(11)
    words = [f"wort{i}" for i in range(300)] + STOP.split() * 25
    item = " ".join(f"exam{i}" for i in range(20))
    rows = []
    for i in range(120):
        rows.append([i, " ".join(rng.choices(words, k=rng.choice([4, 40, 120]))), rng.choice(["en", "de"]), rng.choice(["src0", "src0", "src3", "src12", "src19"])])
    for i in range(120, 150):  # copies
        rows.append([i, rows[rng.randrange(100)][1], "en", "src1"])
    for i in range(150, 160):  # leaks, of which some are a small part of a long text
        own = rng.choices(words, k=40 if i % 2 else 900)
        rows.append([i, " ".join([*own, item, *own[:3]]), "en", "src2"])
    rows += [[160, " ".join(["Junk###"] * 30), "en", "src2"], [161, None, None, None], [162, "", "en", "src2"]]
    full = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never here at all " * 5)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return full, [(1, item), (2, "never here at all " * 5)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in c.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        got[name] = docs.collect()
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    stages = [got[n] for n, _ in c.STAGES]
    ids = lambda rows: sorted(r.doc_id for r in rows)

    kept = [r for r in rows if not test_quality.brute(r[1])[5] and "###" not in r[1]]
    assert ids(stages[0]) == sorted(r[0] for r in kept)

    of = test_simhash.brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if of[r[0]][1] == r[0]]
    assert ids(stages[1]) == sorted(r[0] for r in kept) and len(kept) < len(stages[0])

    clean = {}
    for r in kept:
        n, hit, _, bad = test_decontaminate.brute(r[1], items)
        if not bad:
            clean[r[0]] = r
    assert ids(stages[2]) == sorted(clean)
    assert 0 < sum(150 <= i < 160 for i in clean) < 10
    for r in stages[2]:
        assert "exam0 exam1" not in r.text and r.n_chars == len(r.text)
        assert r.text == clean[r.doc_id][1] or 150 <= r.doc_id < 160

    domain = lambda s: "web" if int(s[3:]) < 10 else "books" if int(s[3:]) < 15 else "reference"
    plain = [(r.doc_id, (domain(r.source), r.lang, r.source), len(r.text.split())) for r in stages[2]]
    want, _ = test_mixing.brute(plain, WEIGHTS, SHARE, EPOCHS, SEED)
    assert ids(stages[3]) == sorted(i for i, n, _ in want for _ in range(n))

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(stages[3], key=lambda r: r.doc_id):
        own = lib.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[4]) == want


def test_run_and_an_empty_table(spark, tmp_path):
    tables(spark, f"{tmp_path}/a")
    assert c.run(spark, f"{tmp_path}/a").count() > 0
    os.makedirs(f"{tmp_path}/b")
    spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert c.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name,stage", c.STAGES[:-1])
def test_stages_pass_columns_of_any_name(spark, tmp_path, name, stage):
    """Names that the stages use themselves, a dot, and nulls in every column."""
    extra = ["mix", "quality", "leak", "a.b", "id", "fp", "_near_id", "_mix_here", "tokens", "copies", "words"]
    text = " ".join(f"wort{i} the of" for i in range(60))
    rows = [(i, t, "en", "src0", 5, *[f"{k}{i}" for k in extra]) for i, t in enumerate([text, text + " more", text, "x " * 300, "", None])]
    rows += [(None,) * (5 + len(extra)), rows[0]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{k}` string" for k in extra)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "never here " * 9), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    for r in got.collect():
        if r.doc_id is not None:
            assert [r[k] for k in extra] == [f"{k}{r.doc_id}" for k in extra]
    assert c.tokens(spark, docs, str(tmp_path)).count() == len(rows)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_with_sql_equal_duckdb(spark):
    import duckdb

    from weir.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(str([x[k] for k in cols]) for x in df.collect()) == sorted(str([x[names.index(k)] for k in cols]) for x in r.fetchall()), name
