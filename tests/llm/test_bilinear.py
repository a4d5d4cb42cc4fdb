import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import weir.llm.bilinear as b


def corpus(n=150):
    rng = random.Random(8)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("the", "der", "que")]
    rows = [(i, " ".join(rng.choices(langs[i % 3], weights=[60 / (k + 1) for k in range(60)], k=rng.randrange(1, 120))), "x") for i in range(n)]
    return rows + [(n, None, "x"), (n + 1, "", None), (n + 2, " \n", "x"), (n + 3, "never Seen BEFORE", "x"), (n + 4, rows[0][1], "x"), (n + 5, "the1 " * 30_000, "x")]


@pytest.mark.parametrize("head", [5, 100_000])
def test_base_equals_brute_force_and_the_model_beats_it(spark, monkeypatch, head):
    rows = corpus()
    monkeypatch.setattr(b, "COUNTED", 500)
    monkeypatch.setattr(b, "SLICE", 3000)
    monkeypatch.setattr(b, "LINE", 200)
    monkeypatch.setattr(b, "STEP", 32)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    train = [r for r in rows if r[0] % 4 and r[0] < 150]
    got = {r.id: r for r in b.score(docs, docs.where("doc_id % 4 != 0 AND doc_id < 150"), head=head).collect()}
    counts = Counter(w for _, t, _ in train for w in [*(t or "").lower().split(), b.END])
    n, v = sum(counts.values()), len(counts)
    better = 0
    for i, t, _ in rows:
        words = [*(t or "").lower().split(), b.END]
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert g.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        if i % 4 == 0 and i < 150:
            better += g.score - g.base_score
    assert better > 0 and got[154].score == pytest.approx(got[0].score) and got[150].score == got[151].score == got[152].score
    assert len(got) == len(rows)


def shares(rng):
    x = rng.random((b.CLASSES, b.SLOTS)).astype(np.float32)
    x[:, 40:-1] = 0  # classes with fewer words than slots
    return x / x.sum(1, keepdims=True)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    m = b.Model(np.full(b.CLASSES, 1 / b.CLASSES, np.float32), shares(rng))
    ctx = np.repeat(rng.integers(0, b.UNITS, (1, b.CONTEXT)), b.UNITS, 0)
    assert (10 ** m.log10_of(ctx, np.arange(b.UNITS))).sum() == pytest.approx(1, abs=1e-4)
    m.q2 *= 1e4  # scores that must be shifted before they are raised
    assert (10 ** m.log10_of(ctx, np.arange(b.UNITS))).sum() == pytest.approx(1, abs=1e-3)


def test_probabilities_of_words_sum_to_one():
    """Over all words and one unknown word in each class, as documents see them."""
    words = [f"w{i}".encode() for i in range(20_000)] + [b.END]
    counts = {w: 1 + 30_000 // (k + 1) for k, w in enumerate(words)}
    of: dict[int, list] = {}
    for w, c in counts.items():
        of.setdefault(b.class_of(w), []).append(c)
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:9_000]
    v = b.Vocabulary(head, sum(counts.values()), len(counts), {k: (sum(x), len(x), x.count(1)) for k, x in of.items()})
    m = b.Model(v.prior, v.share)
    _, units = v.look_up(pa.array(words))
    lp = m.log10_of(np.full((len(words), b.CONTEXT), v.end), units)
    last = units % b.SLOTS == b.SLOTS - 1
    lp[last] += np.log10([counts[w] + 1 for w, x in zip(words, last, strict=True) if x]) - v.within[units[last] // b.SLOTS]
    unknown = np.arange(b.CLASSES) * b.SLOTS + b.SLOTS - 1
    rest = m.log10_of(np.full((b.CLASSES, b.CONTEXT), v.end), unknown) + v.unknown - v.within
    assert (10**lp).sum() + (10**rest).sum() == pytest.approx(1, abs=1e-4)
    assert len(set(units[~last].tolist())) > 5_000


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    r = b.score(docs, docs.limit(0)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert b.score(docs.limit(0), docs).count() == 0


def model(share):
    return b.Model(np.full(b.CLASSES, 1 / b.CLASSES, np.float32), share)


def test_a_step_follows_the_gradient_of_its_loss():
    """A small step along each parameter's gradient raises the contrastive objective as told."""
    rng = np.random.default_rng(4)
    units, share = rng.integers(0, b.UNITS, 40), shares(rng)
    units[share.reshape(-1)[units] == 0] += b.SLOTS - 1 - units[share.reshape(-1)[units] == 0] % b.SLOTS
    classes, slots = units // b.SLOTS, units % b.SLOTS
    inside = np.minimum(np.r_[np.arange(15), np.arange(25)], b.CONTEXT)
    end = 7

    drawn = (np.arange(b.WITHIN_NOISE) % 9 + 0.5) / 9

    class Fixed:
        def random(self, n):
            return (np.arange(n) % 9 + 0.5) / b.CLASSES if isinstance(n, int) else np.broadcast_to(drawn, n)

    def contrast(up, down):
        return -np.log1p(np.exp(-up)).sum() - np.log1p(np.exp(down)).sum()

    def objective(m):
        p = m.predicted(b._contexts(units, np.array([0, 15]), end)).astype(np.float64)
        off = np.log(b.NOISE * m.prior)
        noise = np.arange(b.NOISE) % 9
        total = contrast((p * m.q[classes]).sum(1) + m.b[classes] - off[classes], p @ m.q[noise].T + (m.b - off)[noise])
        for w in range(40):
            c = classes[w]
            x = m.q2[c].astype(np.float64) @ p[w] + (m.b2 - m.offset2)[c]
            total += contrast(x[[slots[w]]], x[np.searchsorted(np.cumsum(share[c].astype(np.float64)) / share[c].sum(dtype=np.float64), drawn, side="right")])
        return total

    base = objective(model(share))
    for name in b.Model.NAMES:
        m, told = model(share), model(share)
        told._g = {k: np.ones_like(g, np.float64) * 1e12 for k, g in told._g.items()}  # then a step is the gradient times a constant
        for k in b.Model.NAMES:
            setattr(told, k, getattr(told, k).astype(np.float64))
        before = getattr(told, name).copy()
        told.learn(np.full(b.CONTEXT, end), inside, units, end, Fixed(), rate=1e6)
        g = (getattr(told, name) - before) * len(units)
        eps = 1e-3 / np.abs(g).max()
        setattr(m, name, getattr(m, name).astype(np.float64) + eps * g)
        assert objective(m) - base == pytest.approx(eps * (g * g).sum(), rel=0.05), name
