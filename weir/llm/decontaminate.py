"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The automaton reads every word of a text and tracks the length of the longest match with any item.
Where it reaches a window (13 words, or a whole shorter item) the window's words are hit. The items are
held in automata of bounded size: a benchmark beyond the bound is dealt into several, which each batch of
texts passes one after another, so neither the driver nor an executor ever holds more than one.

Defined cases: a null, empty or wordless text has no words and no hit; an item without words is never
found; items are told apart by item_id, and an item whose id is null is found but not listed; repeated
rows are judged alike; an empty benchmark hits nothing; an empty table gives an empty table. Columns of
the input called like the result are replaced.
"""

from __future__ import annotations

import hashlib
import re
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import with_result

WINDOW = 13
#: Bytes of items that one automaton holds, unless a single item is longer.
AUTOMATON_BYTES = 1_000_000

#: Upper case to lower case, and all that is not part of a word to a space.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of_item(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Of the items' word sequences; a state is a class of substrings with the same ends."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends = []
        for _, words in items:
            at = 0
            for w in words:
                at = self._extend(at, w)
            ends.append(at)
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: The state of a match's last `window` words.
        self.window_state = [-1] * n
        for s in order:
            if self.length[s] >= window:
                self.window_state[s] = s if self.length[self.link[s]] < window else self.window_state[self.link[s]]
        self.items_of: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for (name, words), end in zip(items, ends, strict=True):
            if 0 < len(words) < window:
                while self.length[self.link[end]] >= len(words):
                    end = self.link[end]
                self.short.setdefault(end, []).append((len(words), name))
            at = 0
            for k, w in enumerate(words):
                at = self.next[at][w]
                if k + 1 >= window:
                    own = self.items_of.setdefault(self.window_state[at], set())
                    if name is not None:
                        own.add(name)
        #: The nearest state with short items, upwards from and including a state.
        self.short_up = [-1] * n
        for s in order:
            self.short_up[s] = s if s in self.short else self.short_up[self.link[s]]
        self.least = min([window, *(len(w) for _, w in items if w)])

    def _state(self, length: int, link: int, arcs: dict[bytes, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The shorter half of q, as met from p."""
        half = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Windows found, as (first word, word after the last), and the items that have them."""
        arcs, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[str] = set()
        at = run = 0
        root = arcs[0]
        for j, w in enumerate(words):
            to = arcs[at].get(w) if at else root.get(w)
            while to is None and at:
                at = link[at]
                run = length[at]
                to = arcs[at].get(w)
            if to is None:
                continue
            at = to
            run += 1
            if run < least:
                continue
            if run >= window:
                spans.append((j + 1 - window, j + 1))
                states.add(self.window_state[at])
            t = self.short_up[at]
            while t >= 0:
                for n, name in self.short[t]:
                    if n <= run:
                        spans.append((j + 1 - n, j + 1))
                        if name is not None:
                            found.add(name)
                t = self.short_up[link[t]] if link[t] >= 0 else -1
        for s in states:
            found |= self.items_of[s]
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what is between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def automata(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> list[Broadcast]:
    """One broadcast automaton for each share of the items; the shares' bytes are bounded, one item at least."""
    items = benchmark.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    size = F.octet_length("t").cast("bigint") + 64
    total = items.agg(F.sum(size)).first()[0] or 0
    sc = benchmark.sparkSession.sparkContext
    shares, largest = 1, total
    while largest > AUTOMATON_BYTES and shares < 1 << 20:
        shares = max(2 * shares, -(-2 * total // AUTOMATON_BYTES))
        by = items.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(shares)).alias("k")).agg(F.sum(size).alias("b"), F.countDistinct("i", "t").alias("n"))
        largest = by.where("n > 1").agg(F.max("b")).first()[0] or 0
    out = []
    for k in range(shares) if total else ():
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shares)) == k).distinct().collect()  # bounded by AUTOMATON_BYTES
        if rows:
            out.append(sc.broadcast(Automaton([(r.i, words_of_item(r.t.encode())) for r in rows], window)))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "leak",
    keep: list[str] | None = None, coverage: tuple[int, int] = (1, 20), window: int = WINDOW, clean: bool = True,
) -> DataFrame:
    """Columns `keep` of docs (all, by default) with a struct `into`.

    It has n_words, n_hit, items, spans (word offsets), contaminated (at least coverage of the words hit)
    and, if `clean`, clean_text: the text without the hit spans.
    """
    parts = automata(benchmark, item, item_text, window)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    part, whole = coverage
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("contaminated", pa.bool_())]
        + [("clean_text", pa.string())] * clean
    )

    def judge(column: pa.Array) -> pa.Array:
        texts = column.cast(pa.large_binary()).to_pylist()
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        n_words = [0] * len(texts)
        for share, p in enumerate(parts):
            scan = p.value.scan
            for k, x in enumerate(texts):
                if x:
                    words = x.translate(_FOLD).split()
                    n_words[k] = len(words)
                    s, i = scan(words)
                    if s:
                        spans[k] += s
                        items[k] |= i
            if len(parts) > 1:
                del p._value  # held one at a time
        if not parts:
            n_words = [len(words_of_item(x)) if x else 0 for x in texts]
        out = []
        for x, s, i, n in zip(texts, spans, items, n_words, strict=True):
            m = merged(s)
            hit = sum(z - a for a, z in m)
            row = {"n_words": n, "n_hit": hit, "items": sorted(i), "spans": [{"start": a, "end": z} for a, z in m], "contaminated": hit > 0 and whole * hit >= part * n}
            if clean:
                row["clean_text"] = None if x is None else without(x, m).decode()
            out.append(row)
        return pa.array(out, kind)

    inner = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, contaminated boolean" + ", clean_text string" * clean
    return with_result(docs, F.col(f"`{text}`"), names, judge, into, inner)


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
