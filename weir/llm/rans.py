"""Static range asymmetric numeral system over token ids: one shared frequency table, independent blocks.

A block holds up to BLOCK ids dealt in turn to LANES states, so each step codes one row of ids at once.
States are 64 bits wide and give or take 32 bits at a time. A block can be decoded with nothing but the
table; its checkpoint (offset, ids before it, length, checksum) is in the file's index.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK = 1 << 18
_MASK = np.uint64((1 << SCALE) - 1)
_S, _W = np.uint64(SCALE), np.uint64(32)
#: A state of a frequency's share of LOW's range, times a word.
_FULL = np.uint64(31 - SCALE + 32)


class Table:
    """Frequencies that sum to 2**SCALE; every symbol that was counted has one at least."""

    def __init__(self, freqs: np.ndarray) -> None:
        self.freqs = freqs.astype(np.uint64)
        if len(freqs) and int(self.freqs.sum()) != 1 << SCALE:
            raise ValueError("frequencies do not fill the range")
        self.starts = np.r_[np.uint64(0), np.cumsum(self.freqs)[:-1]].astype(np.uint64)
        self.symbols = np.repeat(np.arange(len(freqs), dtype=np.uint32), self.freqs.astype(np.int64))
        # half as wide, for look-ups in bulk: they stay in a core's cache
        self.narrow = self.freqs.astype(np.uint32), self.starts.astype(np.uint32)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, n = int(counts.sum()), int((counts > 0).sum())
        if n > 1 << SCALE:
            raise ValueError("more symbols than the range holds")
        room = (1 << SCALE) - n
        freqs = np.where(counts > 0, 1 + np.floor(counts * (room / max(total, 1))), 0).astype(np.int64)
        freqs[int(np.argmax(counts))] += (1 << SCALE) - int(freqs.sum())
        return cls(freqs)

    def to_bytes(self) -> bytes:
        return self.freqs.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        return cls(np.frombuffer(raw, "<u4"))

    def crc(self) -> int:
        return zlib.crc32(self.to_bytes())


def encode(ids: np.ndarray, table: Table) -> bytes:
    """The lanes' last states, then the words that decoding takes, in its order."""
    freqs, starts = (x.take(ids).astype(np.uint64) for x in table.narrow)
    most = freqs << _FULL
    if len(ids) and not freqs.all():
        raise ValueError("an id is not in the table")
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    for a in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        f, c = freqs[a : a + LANES], starts[a : a + LANES]
        own = x[: len(f)]
        full = own >= most[a : a + LANES]
        words.append(own[full].astype("<u4"))  # the low half
        own = np.where(full, own >> _W, own)
        q = own // f
        x[: len(f)] = (q << _S) + (own - q * f) + c
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode(raw: bytes, n: int, table: Table) -> np.ndarray:
    x = np.frombuffer(raw, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", offset=8 * LANES).astype(np.uint64)
    out = np.empty(n, np.uint32)
    freqs, starts = table.narrow
    at = 0
    for a in range(0, n, LANES):
        own = x[: min(LANES, n - a)]
        slot = own & _MASK
        s = table.symbols.take(slot)
        out[a : a + LANES] = s
        own = freqs.take(s) * (own >> _S) + slot - starts.take(s)
        low = np.flatnonzero(own < LOW)
        own[low] = own[low] << _W | words[at : at + len(low)]
        at += len(low)
        x[: len(own)] = own
    if at != len(words) or (x != LOW).any():
        raise ValueError("the block does not end as it began")
    return out
