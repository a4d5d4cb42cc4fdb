"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (of a vocabulary from the training rows) joined to the mean of the vectors
of its hashed character trigrams. Windows of WINDOW words, each overlapping the last by half, are read in
both directions; attention weighs the states; the text's score is that of its worst window. Every window of
every text is scored, CHUNK words at a time, however long a text is.

Training takes a bounded sample of labelled rows, SAMPLE_ROWS of them and their whole texts, on the driver. It
learns from the text alone. The first entry of each vector begins as the log odds of the word or trigram in the
sample, which spares most of the training.

Defined cases: a null, empty or wordless text is one empty window and gets that window's score; repeated
rows are scored alike; an id with several texts or labels is sampled with the least text and the greater label;
rows without an id are never sampled; without labelled rows of both kinds every score is 0.5 less a trifle; an
empty table gives an empty table; columns called like the result are replaced, and all others pass through
whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_result

SAMPLE_ROWS = 3_000
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS, VOCABULARY = 12, 8, 8, 8192, 20_000
#: Words whose inputs a worker holds, and words that are read at once.
HELD, CHUNK = 250_000, 60_000

#: Upper case to lower case; all of ASCII but letters and digits to a space.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of_bytes(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def trigrams(word: bytes) -> list[int]:
    w = b"^" + word + b"$"
    return [zlib.crc32(w[i : i + 3]) % TRIGRAMS for i in range(max(1, len(w) - 2))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """params: word and trigram vectors, input (D x 6H), recurrent (2 x H x 3H) and bias, attention, output."""

    def __init__(self, vocabulary: dict[bytes, int], params: dict[str, np.ndarray]) -> None:
        self.vocabulary, self.p = vocabulary, params

    @classmethod
    def begin(cls, vocabulary: dict[bytes, int], seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        p = {
            "word": f(len(vocabulary) + 1, WORD_DIM, k=0.05), "char": f(TRIGRAMS, CHAR_DIM, k=0.05), "x": f(WORD_DIM + CHAR_DIM, 6 * HIDDEN), "xb": np.zeros(6 * HIDDEN, np.float32),
            "u": f(2, HIDDEN, 3 * HIDDEN), "a": f(2 * HIDDEN, HIDDEN), "av": f(HIDDEN), "o": f(2 * HIDDEN), "ob": np.array([-2.0], np.float32),
        }
        return cls(vocabulary, p)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, trigrams laid end to end, and where each word's trigrams begin."""
        get = self.vocabulary.get
        rows = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        own = [trigrams(w) for w in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return rows, np.fromiter((t for o in own for t in o), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes

    def vectors(self, rows: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(np.r_[starts, len(grams)]).astype(np.float32)
        return np.hstack([self.p["word"][rows], np.add.reduceat(self.p["char"][grams], starts, 0) / n[:, None]])

    def inputs(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, 6 * HIDDEN), np.float32)
        return self.vectors(*self.features(words)) @ self.p["x"] + self.p["xb"]

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """gates: steps x windows x 6H; mask: steps x windows. The logit of each window."""
        t, n, _ = gates.shape
        h, p = HIDDEN, self.p
        states = np.zeros((t, n, 2 * h), np.float32)
        for d in (0, 1):
            u, now = p["u"][d], np.zeros((n, h), np.float32)
            uz, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                g = gates[k, :, 3 * h * d : 3 * h * (d + 1)]
                zr = _sigmoid(g[:, : 2 * h] + now @ uz)
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * now) @ uc)
                new = now + z * (c - now)
                m = mask[k][:, None]
                if keep is not None:
                    keep.append((d, k, now, z, r, c))
                now = np.where(m, new, now) if not m.all() else new
                states[k, :, h * d : h * (d + 1)] = now
        e = np.tanh(states @ p["a"])
        w = np.where(mask, e @ p["av"], np.float32(-1e9))
        w = np.exp(w - w.max(0)) * mask
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * states).sum(0)
        if keep is not None:
            keep.append((states, e, w, pooled))
        return pooled @ p["o"] + p["ob"][0]

    def gradients(self, rows: np.ndarray, grams: np.ndarray, starts: np.ndarray, at: np.ndarray, mask: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """at: steps x windows, indices of words. Of the mean logistic loss."""
        p, h = self.p, HIDDEN
        v = self.vectors(rows, grams, starts)
        gates = (v @ p["x"] + p["xb"])[at]
        keep: list = []
        logit = self.run(gates, mask, keep)
        states, e, w, pooled = keep.pop()
        dl = ((1 / (1 + np.exp(-logit)) - wanted) / len(wanted)).astype(np.float32)
        g = {"o": pooled.T @ dl, "ob": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["o"]
        ds = w[:, :, None] * dpool
        dw = (states * dpool).sum(2)
        dscore = w * (dw - (w * dw).sum(0))
        g["av"] = np.tensordot(dscore, e, 2)
        de = dscore[:, :, None] * p["av"] * (1 - e * e)
        g["a"] = np.tensordot(states, de, ((0, 1), (0, 1)))
        ds += de @ p["a"].T
        dgates = np.zeros_like(gates)
        g["u"] = np.zeros_like(p["u"])
        carry = np.zeros((2, gates.shape[1], h), np.float32)
        for d, k, before, z, r, c in reversed(keep):
            u = p["u"][d]
            m = mask[k][:, None]
            dn = ds[k, :, h * d : h * (d + 1)] + carry[d]
            dnew = dn * m
            dz = dnew * (c - before) * z * (1 - z)
            dc = dnew * z * (1 - c * c)
            drh = dc @ u[:, 2 * h :].T
            dr = drh * before * r * (1 - r)
            dzr = np.hstack([dz, dr])
            carry[d] = dn * ~m + dnew * (1 - z) + drh * r + dzr @ u[:, : 2 * h].T
            g["u"][d][:, : 2 * h] += before.T @ dzr
            g["u"][d][:, 2 * h :] += (r * before).T @ dc
            dgates[k, :, 3 * h * d : 3 * h * (d + 1)] = np.hstack([dzr, dc])
        dgates *= mask[:, :, None]
        per_word = np.zeros((len(v), 6 * h), np.float32)
        np.add.at(per_word, at[mask], dgates[mask])
        g["x"], g["xb"] = v.T @ per_word, per_word.sum(0)
        dv = per_word @ p["x"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], rows, dv[:, :WORD_DIM])
        sizes = np.diff(np.r_[starts, len(grams)])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], grams, np.repeat(dv[:, WORD_DIM:] / sizes[:, None], sizes, 0))
        return g


def windows(n: int) -> list[tuple[int, int]]:
    """Of n words; one empty window if there are none."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - STRIDE), STRIDE)]


def _laid(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words and which of them count, steps x windows."""
    a = np.array(spans, np.int64).reshape(-1, 2)
    steps = np.arange(max(1, int((a[:, 1] - a[:, 0]).max(initial=1))))[:, None]
    mask = a[:, 0] + steps < a[:, 1]
    return np.where(mask, a[:, 0] + steps, 0), mask


class Scorer:
    """A network with the inputs of words met lately."""

    def __init__(self, network: Network) -> None:
        self.net = network
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((HELD, 6 * HIDDEN), np.float32)

    def _at(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > len(self.table):
            rows.clear()
            new = list(dict.fromkeys(words))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), 6 * HIDDEN), np.float32)
        if new:
            first = len(rows)
            self.table[first : first + len(new)] = self.net.inputs(new)
            rows.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def window_logits(self, words: list[bytes]) -> np.ndarray:
        spans = windows(len(words))
        at = self._at(words) if words else np.zeros(1, np.int64)
        out = []
        for k in range(0, len(spans), CHUNK // WINDOW):
            i, mask = _laid(spans[k : k + CHUNK // WINDOW])
            out.append(self.net.run(self.table[at[i]], mask))
        return np.concatenate(out)

    def _worst(self, docs: list[list[bytes]]) -> np.ndarray:
        """The logit of the worst window of each of some texts, of CHUNK words together unless one is longer."""
        if len(docs) == 1:
            return self.window_logits(docs[0]).max(keepdims=True)
        spans, owner, all_ = [], [], []
        for j, own in enumerate(docs):
            s = windows(len(own))
            spans += [(a + len(all_), b + len(all_)) for a, b in s]
            owner += [j] * len(s)
            all_ += own
        at = self._at(all_) if all_ else np.zeros(1, np.int64)
        i, mask = _laid(spans)
        worst = np.full(len(docs), -np.inf)
        np.maximum.at(worst, np.array(owner), self.net.run(self.table[at[i]], mask))
        return worst

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The logit of each text's worst window."""
        out: list[np.ndarray] = []
        held: list[list[bytes]] = []
        n = 0
        for t in texts:
            w = words_of_bytes(t)
            if held and n + len(w) > CHUNK:
                out.append(self._worst(held))
                held, n = [], 0
            held.append(w)
            n += len(w)
        if held:
            out.append(self._worst(held))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 4, seed: int = 1) -> Network:
    """By the loss of each text's worst window."""
    docs = [words_of_bytes(t) for t in texts]
    n = np.array([(labels == 0).sum(), (labels == 1).sum()]) + 1.0
    seen: list[Counter] = [Counter(), Counter()]
    grams: list[Counter] = [Counter(), Counter()]
    for d, y in zip(docs, labels.tolist(), strict=True):
        own = set(d)
        seen[y].update(own)
        grams[y].update({g for w in own for g in trigrams(w)})
    odds = lambda c, k: float(np.clip(np.log((c[1][k] + 0.3) / n[1]) - np.log((c[0][k] + 0.3) / n[0]), -3, 3))
    total = seen[0] + seen[1]
    vocabulary = {w: k + 1 for k, w in enumerate(w for w, c in total.most_common(VOCABULARY) if c > 2)}
    net = Network.begin(vocabulary, seed)
    net.p["word"][0, 0] = 0
    for w, k in vocabulary.items():
        net.p["word"][k, 0] = odds(seen, w)
    net.p["char"][:, 0] = [odds(grams, g) for g in range(TRIGRAMS)]
    if min(n) == 1:
        net.p["o"][:], net.p["ob"][:] = 0, -1e-6
        return net
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    size = 32
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        logits = Scorer(net)
        for k in range(0, len(order), 20 * size):
            some = order[k : k + 20 * size]
            logits.rows.clear()
            worst = []
            for j in some:  # which window speaks for each text
                spans = windows(len(docs[j]))
                worst.append(spans[int(np.argmax(logits.window_logits(docs[j])))] if len(spans) > 1 else spans[0])
            for b in range(0, len(some), size):
                chosen = [docs[j][x:y] for j, (x, y) in zip(some[b : b + size], worst[b : b + size], strict=True)]
                flat = [w for c in chosen for w in c] or [b""]
                ends = np.cumsum([len(c) for c in chosen])
                at, mask = _laid([(e - len(c), e) for e, c in zip(ends.tolist(), chosen, strict=True)])
                g = net.gradients(*net.features(flat), at, mask, labels[some[b : b + size]])
                step += 1
                rate = 0.01 * (1 - 0.8 * (epoch + k / len(order)) / epochs)
                for name, x in g.items():
                    x = np.clip(x, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * x
                    s[name] = 0.99 * s[name] + 0.01 * x * x
                    net.p[name] = net.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)
    # the border between the two verdicts is put where the sample is told apart best
    logits = Scorer(net).score(texts)
    order = np.argsort(logits)
    y = labels[order]
    right = np.r_[0, np.cumsum(y == 0)] + ((y == 1).sum() - np.r_[0, np.cumsum(y == 1)])
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    border = (logits[order[max(k - 1, 0)]] + logits[order[min(k, len(y) - 1)]]) / 2
    net.p["ob"] = (net.p["ob"] - border).astype(np.float32)
    return net


def train_on(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Network:
    """From at most `rows` labelled rows, half of them toxic if there are as many, picked by a hash of the id."""
    wanted = labels.select(F.col(f"`{id}`").cast("bigint").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    picked = [wanted.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows // 2) for y in (0, 1)]
    ids = picked[0].union(picked[1])
    named = docs.select(F.col(f"`{id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"))
    found = named.where("t IS NOT NULL").join(F.broadcast(ids), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))  # at most `rows` rows
    got = sorted(found.collect(), key=lambda r: r.i)
    return train([r.t.encode() for r in got], np.array([r.y for r in got], np.int64))


def score(docs: DataFrame, network: Network, text: str = "text", into: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all, by default) with a struct `into`: score and predicted."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    held: dict[str, Scorer] = {}

    def run(texts: pa.Array) -> pa.Array:
        scorer = held.get("x") or held.setdefault("x", Scorer(shared.value))
        s = 1 / (1 + np.exp(-np.clip(scorer.score([x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]), -500, 500)))
        return pa.StructArray.from_arrays([pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["score", "predicted"])

    return with_result(docs, F.col(f"`{text}`"), names, run, into, "score double, predicted int")
