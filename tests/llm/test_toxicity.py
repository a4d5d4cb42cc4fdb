import random

import numpy as np

from weir.llm import toxicity as t


def sample(rng, n):
    plain = [f"wort{i}" for i in range(80)]
    texts, labels = [], []
    for k in range(n):
        w = rng.choices(plain, k=rng.choice([1, 5, 40, 200]))
        if k % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["rotter", "scumbag", "nitwit"]) + rng.choice(["", "!", "."])
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_gradients_equal_differences():
    net = t.Network.begin({b"a": 1, b"b": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"a", b"b", b"zz", b"a", b"q"]
    at, mask = t._laid([(0, 3), (3, 5), (1, 1)])
    y = np.array([1, 0, 1])

    def loss():
        z = net.run((net.vectors(*net.features(words)) @ net.p["x"] + net.p["xb"])[at], mask)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.gradients(*net.features(words), at, mask, y)
    rng = np.random.default_rng(0)
    for name, p in net.p.items():
        flat, own = p.reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in [int(np.abs(own).argmax()), *rng.integers(0, flat.size, 3)]:
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2 / eps - own[i]) < 1e-4 + 0.02 * abs(own[i]), (name, i)


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(1)
    texts, labels = sample(rng, 400)
    net = t.train([x.encode() for x in texts], np.array(labels), epochs=4)
    texts, labels = sample(rng, 200)
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(1000, None, "s"), (1001, "", "s"), (1002, "!?", None), (1003, texts[0], "s"), (1004, "wort1 " * 30_000 + "scumbag", "s")]
    got = {r.doc_id: r.toxicity for r in t.score(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), net).collect()}
    right = sum(got[i].predicted == y for i, y in enumerate(labels))
    assert right / len(labels) > 0.95
    assert got[1000] == got[1001] == got[1002] and got[1003] == got[0] and got[1004].predicted == 1
    assert all(0 <= s.score <= 1 and s.predicted == int(s.score >= 0.5) for s in got.values())


def test_a_very_long_text_beside_short_ones_is_read_in_bounded_memory():
    texts, labels = sample(random.Random(3), 60)
    net = t.train([x.encode() for x in texts], np.array(labels), epochs=1)
    scorer, sizes, run = t.Scorer(net), [], net.run
    net.run = lambda gates, mask, keep=None: sizes.append(gates.size) or run(gates, mask, keep)
    long_ = b"wort1 wort2 " * 500_000
    got = scorer.score([b"wort1", long_ + b"scumbag!", b"", b"wort2 wort3"])
    assert max(sizes) <= 2 * t.CHUNK * 6 * t.HIDDEN
    alone = [scorer.score([x])[0] for x in (b"wort1", long_ + b"scumbag!", b"", b"wort2 wort3")]
    assert np.allclose(got, alone, rtol=0, atol=1e-5)  # products of other shapes round otherwise
    assert len(scorer.score([])) == 0


def test_repeated_ids_and_columns_with_clashing_names(spark):
    texts, labels = sample(random.Random(4), 30)
    docs = spark.createDataFrame([(i, x, "a", "b") for i, x in enumerate(texts)] + [(3, "zz", None, None), (None, "x", "a", None)], "doc_id bigint, text string, `a.b` string, predicted string")
    marked = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(3, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    one, two = t.train_on(docs, marked), t.train_on(docs.repartition(3), marked.repartition(2))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    got = t.score(docs, one)
    assert got.columns == [*docs.columns, "toxicity"] and got.count() == 32


def test_every_word_is_in_a_window():
    for n in range(200):
        w = t.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n
        assert all(b <= d and c < b for (a, b), (c, d) in zip(w, w[1:]))


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    net = t.train_on(docs, none)
    assert t.score(docs, net).first().toxicity.predicted == 0
    assert t.score(docs.limit(0), net).count() == 0
