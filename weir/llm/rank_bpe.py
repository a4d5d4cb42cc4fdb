"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie end to end in one array of symbols, with one row number each. In each round
every row finds its pair of lowest rank, all rows merge all places of their own pair at once, and rows
without a pair leave with the number of symbols that survive. Texts are cut at spaces first, and each
distinct piece is merged once while it stays in a table of bounded size, so the work on common pieces is
a look-up. No id is ever made: only counts.

Defined cases: a null or empty text has no tokens; strings of special tokens inside a text count as one
token each, as the tokenizer's default is; a very long text is merged in batches of bounded size, and a piece
of more than LONGEST characters is not held; repeated rows are counted alike; other columns are returned as
they are, except one called like the result; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_tokens import KNOWN, LONGEST
from .shared import byte_letters, with_result

#: Pieces whose counts a worker holds; beyond it the table is begun anew.
TABLE = 700_000
#: Symbols that are merged at once.
BATCH = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)


class RankCounter:
    """Counts tokens as the byte-pair tokenizer in a tokenizers file of this kind does: NFC, lower case, word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        end = model["end_of_word_suffix"]
        ids = model["vocab"]
        if max(ids.values()) >= 1 << 16:
            raise ValueError("a pair's key holds ids of 16 bits")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.uint32)
        right = np.array([ids[b] for _, b in pairs], np.uint32)
        self._fill(left << np.uint32(16) | right, np.array([ids[a + b] for a, b in pairs], np.int32))
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.known = regex.compile(f"[{regex.escape(''.join(map(chr, KNOWN)))}]*").fullmatch
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.uint32)
        self.last = np.array([ids[letters[b] + end] for b in range(256)], np.uint32)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.table: dict[str, int] = {}

    def _fill(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open hash table from pairs to (rank, symbol made)."""
        self.bits = 19
        size = 1 << self.bits
        self.keys = np.full(size, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(size, NONE, np.int32)
        self.made = np.zeros(size, np.uint32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] == 0xFFFFFFFF
            self.keys[slot[free]] = keys[todo[free]]  # the last of equals wins
            won = free & (self.keys[slot] == keys[todo])
            self.ranks[slot[won]] = todo[won]
            self.made[slot[won]] = made[todo[won]]
            todo = todo[~won]
            at[todo] = at[todo] + 1 & size - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair, or that of an empty place if it has no rank."""
        at = self._home(keys)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != 0xFFFFFFFF))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            got = self.keys[at[todo]]
            todo = todo[(got != keys[todo]) & (got != 0xFFFFFFFF)]
        return at

    def merge(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive of each word; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        row = np.repeat(np.arange(len(words)), sizes)
        counts = np.ones(len(words), np.int64)
        while len(symbols) > 1:
            inside = row[1:] == row[:-1]
            slot = self._slots(symbols[:-1] << np.uint32(16) | symbols[1:])
            ranks = np.where(inside, self.ranks[slot], NONE)
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(np.r_[ranks, NONE], starts)
            size = np.diff(np.r_[starts, len(symbols)])
            over = lowest == NONE
            counts[row[starts[over]]] = size[over]
            best = np.repeat(lowest, size)[:-1]
            hit = np.flatnonzero((ranks == best) & (ranks != NONE))
            if not len(hit):
                break
            # of overlapping places the first, third, ... merge
            run = np.r_[True, np.diff(hit) > 1]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
            symbols[hit] = self.made[slot[hit]]
            keep = np.repeat(~over, size)
            keep[hit + 1] = False
            symbols, row = symbols[keep], row[keep]
        return counts

    def _words(self, part: str) -> list[bytes]:
        """The pre-tokens of a part of a text. Beyond ASCII the library normalises, and cuts what holds characters
        that Python's tables may class otherwise."""
        if part.isascii():
            return [w.encode() for w in self.find(part.lower())]
        part = self.normal(part)
        if self.known(part):
            return [w.encode() for w in self.find(part)]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.cut(part)]

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Counts of pieces that the table does not have."""
        base = np.zeros(len(pieces), np.int64)
        numbers: dict[bytes, int] = {}
        owner: list[int] = []
        word: list[int] = []
        for k, piece in enumerate(pieces):
            parts = [piece]
            if "<|" in piece:
                parts = self.special.split(piece)
                base[k] = len(parts) - 1
            for p in parts:
                for w in self._words(p):
                    owner.append(k)
                    word.append(numbers.setdefault(w, len(numbers)))
        if owner:
            own = list(numbers)
            counts = np.zeros(len(own), np.int64)
            at = 0
            while at < len(own):
                size, to = 0, at
                while to < len(own) and (to == at or size + len(own[to]) <= BATCH):
                    size += len(own[to])
                    to += 1
                counts[at:to] = self.merge(own[at:to])
                at = to
            np.add.at(base, np.array(owner), counts[np.array(word)])
        return dict(zip(pieces, base.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        table = self.table
        pieces = [t.split(" ") for t in texts]
        new = list({p for own in pieces for p in own if p not in table})
        if new:
            got = self._learn(new)
            if len(table) + len(got) > TABLE:
                table.clear()
                # what this batch needs must be there, whatever its size
                table.update(self._learn(list({p for own in pieces for p in own} - got.keys())))
            table.update(got)
        of = table.__getitem__
        out = [sum(map(of, own)) for own in pieces]
        for p in new:
            if len(p) > LONGEST:
                table.pop(p, None)
        return out


_COUNTERS: dict[str, RankCounter] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, into: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all, by default) with a struct `into`: n_bytes, n_tokens, over_limit.

    path: the tokenizer's file, which every executor must have.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]

    def count(column: pa.Array) -> pa.Array:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, RankCounter(path))
        texts = column.to_pylist()
        n: list[int] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= 4 * BATCH):
                size += len(texts[to])
                to += 1
            n += counter.count(texts[at:to])
            at = to
        sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["n_bytes", "n_tokens", "over_limit"])

    return with_result(docs, F.coalesce(F.col(f"`{text}`"), F.lit("")), names, count, into, "n_bytes bigint, n_tokens bigint, over_limit boolean")
