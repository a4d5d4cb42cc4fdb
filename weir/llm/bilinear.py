"""Language-model scores by a log-bilinear neural model, trained with noise-contrastive estimation in numpy.

A word belongs to one of CLASSES classes by its last two bytes. Within a class the most frequent words, up to
SLOTS - 1 of those in the head of the vocabulary, are units of their own; all others share the last unit. The
next word's class is predicted from the vectors of the units of the CONTEXT words before it, each weighed entry
by entry for its place, and its unit among those of its class from the same prediction. Both are normalised, by
a matrix product over all classes and one over the units of a class, and a word of a shared unit has its share
of that unit's training count. A class holds one unknown word, which weighs as many as it has words that were
met once: a text's score is the log10 of a proper probability.

    counts    every training word is counted (partial counts leave the tasks, then one shuffle)
    training  every partition of training texts trains from one start over all its words; the parameters
              are averaged, weighed by words, in an aggregation
    scoring   frequent words are looked up in a table of at most HEAD rows; the rest is joined with the
              counts, so no table that grows with the corpus is sent to executors

Classes are told apart from noise classes drawn by their frequency, which a step shares; units from noise units
drawn by their share of the class, which BLOCK words share.

Defined cases: a null, empty or blank text is the end alone; repeated rows, ties in counts and repeated ids are
each scored alike; a very long text is one row, held by one task; columns beside id and text, whatever they are
called, are not read; an empty training set makes every word unknown; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, written

CLASSES, SLOTS = 128, 64
UNITS = CLASSES * SLOTS
CONTEXT, DIM = 5, 24
#: Frequent words that every executor holds, at most.
HEAD = 150_000
#: The end of a text, which no word can be.
END = b" "
NOISE, WITHIN_NOISE, STEP, SCORE_STEP = 48, 16, 2048, 768
#: Words of a class that share noise units.
BLOCK = 16
#: Bytes of texts whose words are numbered at once, in counting and in reading them; words that are scored at once.
COUNTED, SLICE, LINE = 1 << 24, 1 << 22, 1 << 17
#: Parameters that a row holds while models are averaged.
ROW = 64


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def _class(word: str) -> Column:
    """class_of as a column."""
    return F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(CLASSES)).cast("int")


#: The class of a word that ends in each pair of bytes, and of one that is a single byte.
_PAIRS = np.array([class_of(bytes([a, b])) for a in range(256) for b in range(256)])
_SINGLES = np.array([class_of(bytes([a])) for a in range(256)])


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, its end included; the words' numbers, end to end; the words. The end is 0."""
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    n = np.diff(cut.offsets.to_numpy()).astype(np.int64)
    both = pa.concat_arrays([pa.array([END.decode()]), cut.flatten()]).dictionary_encode()
    codes, words = both.indices.to_numpy()[1:], both.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:  # of a text without words
        keep = codes != blank
        n -= np.add.reduceat(~keep, np.cumsum(n) - n)
        codes = codes[keep]
    return n + 1, np.insert(codes, np.cumsum(n), 0), words.cast(pa.binary())


def _slices(batches: Iterator[pa.RecordBatch], size: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in batches:
        texts = pc.fill_null(b.column(column), "")
        for a, z in slices(texts, size):
            yield b.slice(a, z - a), texts.slice(a, z - a)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, COUNTED):
            _, codes, words = numbered(texts)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "c"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "word binary, c bigint").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head's words with their counts and units, and how much each unit holds."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, classes: dict[int, tuple[int, int, int]]) -> None:
        """head: the most frequent first; classes: (count, distinct words, those met once) of each class over the
        whole vocabulary."""
        self.total, self.distinct = total, distinct
        self.words = pa.array([w for w, _ in head], pa.binary())
        self.logs = np.log10(np.array([c for _, c in head], np.float64) + 1)
        held = np.zeros((CLASSES, SLOTS))
        taken = np.zeros(CLASSES, np.int64)
        self.units = np.zeros(len(head), np.int64)
        for k, (w, c) in enumerate(head):
            of = class_of(w)
            slot = min(int(taken[of]), SLOTS - 1)
            self.units[k] = of * SLOTS + slot
            if slot < SLOTS - 1:
                held[of, slot] = c
                taken[of] += 1
        all_, kinds, unknown = np.zeros(CLASSES), np.zeros(CLASSES), np.full(CLASSES, 1 / CLASSES)
        for k, (c, v, once) in classes.items():
            all_[k], kinds[k] = c, v
            unknown[k] += once
        #: Of the shared unit: counts, one for each of its words, and the unknown word.
        held[:, -1] = all_ - held[:, :-1].sum(1) + kinds - taken + unknown
        self.within, self.unknown = np.log10(held[:, -1]), np.log10(unknown)
        n = held.sum(1)
        #: How likely each class is, and each unit within its class, whatever stands before.
        self.prior = (n / n.sum()).astype(np.float32)
        self.share = (held / n[:, None]).astype(np.float32)
        self.end = int(self.look_up(pa.array([END]))[1][0])

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row in the head (-1: not there) and unit of each word; no word is empty."""
        rows = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64), np.frombuffer(words.buffers()[2], np.uint8)
        last = data[ends[1:] - 1].astype(np.int64)
        classes = np.where(np.diff(ends) > 1, _PAIRS[data[np.maximum(ends[1:] - 2, 0)].astype(np.int64) * 256 + last], _SINGLES[last])
        units = classes * SLOTS + SLOTS - 1
        known = rows >= 0
        units[known] = self.units[rows[known]]
        return rows, units


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts by steps of a sixteenth of an octave: a few hundred rows say from which count on words fit the head
    step = F.floor(F.log2("c") * 16)
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True)
    least, room = None, head
    for s in steps:
        room -= s.n
        if room < 0:
            break
        least = s.least
    rows = [] if least is None else counts.where(F.col("c") >= least).collect()  # at most `head` rows
    rows.sort(key=lambda r: (-r.c, bytes(r.word)))
    by = counts.groupBy(_class("word").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"))
    classes = {r.k: (r.c, r.v, r.once) for r in by.collect()}  # one for each class
    return Vocabulary([(bytes(r.word), r.c) for r in rows], total, distinct, classes)


def _contexts(classes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """For each place the CONTEXT classes before it, nearest first; before a text stand ends."""
    at = np.arange(len(classes))
    first = np.repeat(starts, np.diff(np.r_[starts, len(classes)]))
    out = np.empty((len(classes), CONTEXT), np.int64)
    for k in range(CONTEXT):
        before = at - k - 1
        out[:, k] = np.where(before >= first, classes[np.maximum(before, 0)], end)
    return out


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, which is below n."""
    width = rows.shape[1]
    places = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(places, rows.ravel(), n * width).reshape(n, width)


def _sums_of_some(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices that occur, each once, and the sums of their rows."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index = index[order]
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index[first], np.add.reduceat(rows[order], first, 0)


def _gathered(placed: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    out = placed[0].take(context[:, 0], 0)
    for k in range(1, CONTEXT):
        out += placed[k].take(context[:, k], 0)
    return out


def _off(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _of_class(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class that occurs, with its places."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES))
    for c, (a, z) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
        if a < z:
            yield c, order[a:z]


_ONES = np.ones(max(CLASSES, SLOTS), np.float32)
_NONE = np.float32(-1e4)


class Model:
    """r: units as context; q, b: classes; q2, b2: units within their class; c: places of the context."""

    NAMES = ("r", "q", "c", "b", "q2", "b2")

    def __init__(self, prior: np.ndarray, share: np.ndarray, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.prior, self.share = prior, share
        self.r = (r.standard_normal((UNITS, DIM)) * 0.1).astype(np.float32)
        self.q = (r.standard_normal((CLASSES, DIM)) * 0.1).astype(np.float32)
        self.c = (np.ones((CONTEXT, DIM)) / CONTEXT).astype(np.float32)
        self.b = np.log(prior)
        self.q2 = (r.standard_normal((CLASSES, SLOTS, DIM)) * 0.1).astype(np.float32)
        self.b2 = np.where(share > 0, np.log(np.maximum(share, 1e-30)), _NONE).astype(np.float32)
        self.offset, self.cumulated = np.log(NOISE * prior), np.cumsum(prior.astype(np.float64) / prior.sum(dtype=np.float64))
        self.offset2 = np.where(share > 0, np.log(np.maximum(WITHIN_NOISE * share, 1e-30)), 0).astype(np.float32)
        # the units of class k lie between k and k + 1
        within = np.cumsum(share.astype(np.float64), 1) / np.maximum(share.sum(1, dtype=np.float64), 1e-30)[:, None]
        self.cumulated2 = (np.arange(CLASSES)[:, None] + within).ravel()
        self.last = np.array([k * SLOTS + (np.flatnonzero(x)[-1] if x.any() else 0) for k, x in enumerate(share)])
        self._g = {k: np.full_like(getattr(self, k), 1e-2) for k in self.NAMES}

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return _gathered([self.r * c for c in self.c], context)

    def _ahead(self, before: np.ndarray, inside: np.ndarray, units: np.ndarray, end: int) -> tuple:
        """The predictions of a run, one row for each entry, and what their gradients need."""
        n, row = len(units), np.concatenate([before, units])
        vectors = np.ascontiguousarray(self.r[row].T)  # long rows are quick to work on
        at = [slice(CONTEXT - 1 - k, CONTEXT - 1 - k + n) for k in range(CONTEXT)]
        outside = [np.flatnonzero(inside <= k) for k in range(CONTEXT)]
        seen = [vectors[:, at[k]] for k in range(CONTEXT)]
        for k, o in enumerate(outside):
            if len(o):
                seen[k] = seen[k].copy()
                seen[k][:, o] = self.r[end][:, None]
        p = seen[0] * self.c[0][:, None]
        for k in range(1, CONTEXT):
            p += seen[k] * self.c[k][:, None]
        return p, (row, at, outside, seen)

    def _back(self, dp: np.ndarray, kept: tuple, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units whose vectors are to change, by how much, and how much the places' weights are."""
        row, at, outside, seen = kept
        gc, back, ends = np.empty_like(self.c), np.zeros((DIM, len(row)), dp.dtype), np.zeros(DIM, dp.dtype)
        for k in range(CONTEXT):
            gc[k] = np.einsum("dn,dn->d", dp, seen[k])
            own, o = dp * self.c[k][:, None], outside[k]
            if len(o):
                ends += own[:, o].sum(1)
                own[:, o] = 0
            back[:, at[k]] += own
        return *_sums_of_some(np.r_[row, end], np.vstack([back.T, ends])), gc

    def _move(self, name: str, g: np.ndarray, n: int, rate: float, some: np.ndarray | slice = slice(None)) -> None:
        x, acc = getattr(self, name), self._g[name]
        g = g / n
        a = acc[some] + g * g
        acc[some] = a
        x[some] += rate * g / np.sqrt(a)

    def _against_classes(self, p: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of p, q and b: the classes of a run of words against noise that they share."""
        noise = np.minimum(np.searchsorted(self.cumulated, rng.random(NOISE), side="right"), CLASSES - 1)
        own_q, noise_q = np.ascontiguousarray(self.q[words].T), self.q[noise]
        up = _off((p * own_q).sum(0) + (self.b - self.offset)[words])
        down = -_off(-(noise_q @ p + (self.b - self.offset)[noise][:, None]))
        dp = up * own_q + noise_q.T @ down
        gq = _sums(words, (up * p).T, CLASSES).astype(self.q.dtype)
        gb = np.bincount(words, up, CLASSES).astype(self.b.dtype)
        np.add.at(gq, noise, down @ p.T)
        np.add.at(gb, noise, down.sum(1))
        return dp, gq, gb

    def _against_units(self, p: np.ndarray, units: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of p, and units with those of q2 and b2: units against noise of their class.

        The words of a class lie together in blocks, the last of which has room left, and a block shares noise.
        """
        n = len(units)
        order = np.argsort((units // SLOTS).astype(np.uint8), kind="stable")
        own = units[order]
        count = np.bincount(own // SLOTS, minlength=CLASSES)
        blocks = -(-count // BLOCK)
        of = np.repeat(np.arange(CLASSES), blocks)
        start = (np.cumsum(count) - count)[of] + (np.arange(len(of)) - (np.cumsum(blocks) - blocks)[of]) * BLOCK
        at = start[:, None] + np.arange(BLOCK)
        room = at >= np.cumsum(count)[of][:, None]
        sorted_ = np.concatenate([np.ascontiguousarray(p.T)[order], np.zeros((1, DIM), p.dtype)])
        placed = sorted_[np.where(room, n, at)]
        noise = np.minimum(np.searchsorted(self.cumulated2, of[:, None] + rng.random((len(of), WITHIN_NOISE)), side="right"), self.last[of][:, None])
        q, b = self.q2.reshape(UNITS, DIM), self.b2.reshape(-1) - self.offset2.reshape(-1)
        own_q, noise_q = q[own], q[noise]
        up = _off(np.einsum("nd,nd->n", sorted_[:n], own_q) + b[own])
        x = placed @ noise_q.transpose(0, 2, 1)
        x += b[noise][:, None, :]
        down = _off(np.negative(x, out=x))  # how sure each noise unit is not noise
        down[room] = 0
        dp = up[:, None] * own_q - (down @ noise_q)[~room]
        rows = np.empty((n + noise.size, DIM + 1), p.dtype)
        np.multiply(sorted_[:n], up[:, None], out=rows[:n, :DIM])
        rows[:n, DIM] = up
        rows[n:, :DIM] = (down.transpose(0, 2, 1) @ placed).reshape(-1, DIM)
        rows[n:, DIM] = down.sum(1).ravel()
        np.negative(rows[n:], out=rows[n:])
        back = np.empty_like(dp)
        back[order] = dp
        return back.T, *_sums_of_some(np.r_[own, noise.ravel()], rows)

    def learn(self, before: np.ndarray, inside: np.ndarray, units: np.ndarray, end: int, rng: np.random.Generator, rate: float = 0.08) -> None:
        """One step of noise-contrastive estimation over a run of words, of their classes and of units within those.

        before: the CONTEXT units ahead of the run; inside: for each word, how many words of its text stand
        before it (CONTEXT at most). Vectors are fetched and gradients summed once for the run, as the contexts of
        neighbours are the same words shifted.
        """
        p, kept = self._ahead(before, inside, units, end)
        dp, gq, gb = self._against_classes(p, units // SLOTS, rng)
        dp2, moved, g2 = self._against_units(p, units, rng)
        some, gr, gc = self._back(dp + dp2, kept, end)
        n = len(units)
        self._move("r", gr, n, rate, some)
        self._move("c", gc, n, rate)
        self._move("q", gq, n, rate)
        self._move("b", gb, n, rate)
        at = moved // SLOTS, moved % SLOTS
        self._move("q2", g2[:, :DIM], n, rate, at)
        self._move("b2", g2[:, DIM], n, rate, at)

    @staticmethod
    def _sure(x: np.ndarray, own: np.ndarray, safe: bool) -> np.ndarray:
        """log of the softmax of rows x at the entries whose values are own; x is used up."""
        if not safe:
            top = x.max(1)
            x -= top[:, None]
            own = own - top
        np.exp(x, out=x)
        return own - np.log(x @ _ONES[: x.shape[1]])

    def log10_of(self, context: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Batches are small enough for their scores to stay in cache. Scores are far below where a float
        overflows, which the norms say at once; else the rows' maxima are taken out first."""
        placed = [self.r * c for c in self.c]
        norm = lambda x: float(np.sqrt((x * x).sum(-1)).max())
        reach = sum(map(norm, placed))
        safe = reach * norm(self.q) + float(np.abs(self.b).max()) < 80
        safe2 = reach * norm(self.q2) + float(np.abs(self.b2[self.share > 0]).max(initial=0)) < 80
        classes, slots = units // SLOTS, units % SLOTS
        q = np.vstack([self.q.T, self.b])
        q2 = np.concatenate([self.q2, self.b2[:, :, None]], 2).transpose(0, 2, 1)
        p = np.ones((len(units), DIM + 1), np.float32)
        out = np.empty(len(units))
        s = np.empty((SCORE_STEP, CLASSES), np.float32)
        for a in range(0, len(units), SCORE_STEP):
            some = p[a : a + SCORE_STEP]
            n = len(some)
            some[:, :DIM] = _gathered(placed, context[a : a + SCORE_STEP])
            x = np.matmul(some, q, out=s[:n])
            out[a : a + n] = self._sure(x, x[np.arange(n), classes[a : a + n]], safe)
        for c, at in _of_class(classes):
            for a in range(0, len(at), SCORE_STEP):
                some = at[a : a + SCORE_STEP]
                x = p[some] @ q2[c]
                out[some] += self._sure(x, x[np.arange(len(some)), slots[some]], safe2)
        return out / np.log(10)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self.NAMES]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> Model:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", seed: int = 3) -> Model:
    """Each partition passes over all its words once; parameters are averaged by words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # at most HEAD words
    names = [f"x{k}" for k in range(ROW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        m, rng, total = Model(v.prior, v.share, seed), np.random.default_rng(seed), 0
        for _, texts in _slices(batches, SLICE):
            sizes, codes, words = numbered(texts)
            units = v.look_up(words)[1][codes]
            inside = np.minimum(np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes), CONTEXT)
            ahead = np.concatenate([np.full(CONTEXT, v.end), units])
            for a in rng.permutation(np.arange(0, len(units), STEP)).tolist():
                m.learn(ahead[a : a + CONTEXT], inside[a : a + STEP], units[a : a + STEP], v.end, rng)
            total += len(units)
        if total:
            flat = m.flat()
            rows = np.pad(flat, (0, -len(flat) % ROW)).reshape(-1, ROW) * total
            columns = [pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), total)), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(ROW)]]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", *names])

    schema = "k bigint, n bigint, " + ", ".join(f"{x} double" for x in names)
    sums = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, schema).groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    model = Model(vocab.prior, vocab.share, seed)
    got = sorted(sums.collect())  # one for each ROW parameters
    if got:
        model.filled(np.concatenate([np.array(r[2:]) / r.n for r in got]))
    return model


def score(docs: DataFrame, train_on: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, learned from train_on."""
    counts = written(word_counts(train_on, text))
    vocab = vocabulary(counts, head)
    model = train(train_on, vocab, text)
    model._g = {}
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))  # at most HEAD words and the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        for b, texts in _slices(batches, SLICE, 1):
            sizes, codes, words = numbered(texts)
            starts = np.cumsum(sizes) - sizes
            rows, units = (x[codes] for x in v.look_up(words))
            known = rows >= 0
            logs = np.where(known, v.logs[rows], 0.0) if len(v.logs) else np.zeros(len(rows))
            context, classes = _contexts(units, starts, v.end), units // SLOTS
            lp = np.concatenate([m.log10_of(context[k : k + LINE], units[k : k + LINE]) for k in range(0, len(units), LINE)])
            lp += np.where(units % SLOTS == SLOTS - 1, np.where(known, logs, v.unknown[classes]) - v.within[classes], 0.0)
            # words beyond the head, each once for its text
            lost = np.flatnonzero(~known)
            of, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[lost] * len(words) + codes[lost], return_counts=True)
            pairs = pa.StructArray.from_arrays([words.take(pa.array(of % len(words))), pa.array(n, pa.int64())], names=["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of // len(words), np.arange(len(sizes) + 1)), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                 pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(lp, starts)), tail],
                names=["id", "n_tokens", "known", "logs", "lp", "tail"],
            )

    passed = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "id bigint, n_tokens bigint, known bigint, logs double, lp double, tail array<struct<word:binary,n:bigint>>")
    passed = written(passed.withColumn("row", F.monotonically_increasing_id()))  # written once, so a row keeps its number
    tail = passed.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    unknown = F.element_at(F.array(*[F.lit(float(x)) for x in vocab.unknown]), _class("word") + 1)
    logs = F.log10(F.col("c") + 1)
    found = tail.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * logs).alias("weight"), F.sum(F.col("n") * (logs - unknown)).alias("gain"))
    both = passed.drop("tail").join(found, "row", "left").fillna({"more": 0, "weight": 0.0, "gain": 0.0})
    return both.select(
        "id", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(int(vocab.total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.col("weight") - F.col("n_tokens") * F.lit(float(np.log10(vocab.total + vocab.distinct + 1)))).alias("base_score"),
        (F.col("lp") + F.col("gain")).alias("score"),
    )
