"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once while held.

A byte-level pre-tokenizer never joins what stands before a space to what follows it, unless that is white
space too. So a text is cut before each other space, and the ids of the pieces, one after the other, are those
of the text. A piece that is new is cut into pre-tokens, each of which goes to the library's
model once while held.

Which characters are letters or numbers is asked of the library itself, once for each character of KNOWN. A
piece with any other character, or with a special token in it, goes through the library's whole tokenizer:
its tables of characters may be those of another Unicode version than Python's. Pieces of more than LONGEST
characters are not held, so a table's size is bounded whatever the texts are.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .held import Held
from .shared import byte_letters

#: Pieces that are held. With those of a slice they stay below 2**20, beyond which Arrow's table grows from 32 to 128 MB.
TABLE = 750_000
#: Pieces that are Python objects, or have the places of their ids spelled out, at once.
SPAN = 1 << 16

#: Characters that pieces may be cut at: Latin, Greek, Cyrillic and their marks; general punctuation.
KNOWN = [*range(0x600), *range(0x2000, 0x2070)]
LONGEST = 64

_CUT = re.compile(r" (?=\S)").split
#: White space, or what Python takes for it, behind a space; or a space at the end.
_ODD = r" [\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{206f}\x{3000}]| $"
_SHOWN = byte_letters()

#: White space as Unicode has it, and the pre-tokenizer that is followed here.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class PieceTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokens_of = self.library.model.tokenize
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        if json.loads(self.library.pre_tokenizer.__getstate__()) != PRE_TOKENIZER or self.library.normalizer is not None:
            raise ValueError("not a byte-level tokenizer of this kind")
        parts = self.library.pre_tokenizer.pre_tokenize_str
        letters = [c for c in map(chr, KNOWN) if len(parts(f"a{c}a")) == 1]
        numbers = [c for c in map(chr, KNOWN) if len(parts(f"1{c}1")) == 1]
        letter, number = re.escape("".join(letters)), re.escape("".join(numbers))
        self.known = re.compile(f"[{re.escape(''.join(map(chr, KNOWN)))}]*").fullmatch
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)").search
        self.new = self._pieces()
        self.pieces = Held(self.new, TABLE // 12, LONGEST)
        self.parts = Held(self._part, TABLE // 3, LONGEST)
        self._forget()

    def _forget(self) -> None:
        """self.last: the turn, one for each call of encode_all, in which a piece was used last."""
        self.held, self.sizes, self.ids, self.last, self.turn = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, self.dtype), np.zeros(0, np.int32), 0

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _part(self, part: str) -> bytes:
        """A pre-token, a space before it included."""
        shown = part.replace(" ", "Ġ") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_SHOWN)
        return self._packed([t.id for t in self.tokens_of(shown)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _pieces(self) -> Callable[[str], bytes]:
        """What gives the ids of a piece behind a space. Most new pieces are plain letters: those take the least steps."""
        tokens_of, code, swap = self.tokens_of, self.code, sys.byteorder == "big"

        def piece(x: str) -> bytes:
            if x.isascii() and x.isalpha() and not swap:
                return array(code, [t.id for t in tokens_of("Ġ" + x)]).tobytes()
            x = " " + x
            if not self.known(x) or self.special(x):
                return self._whole(x)
            first, *rest = self.find(x)
            if not rest:
                return self._part(first)
            head = self.pieces[first[1:]] if first[0] == " " and first != " " else self.parts[first]
            return head + b"".join(map(self.parts.__getitem__, rest))

        return piece

    def _first(self, piece: str) -> bytes:
        """A piece at the beginning of a text."""
        if not self.known(piece) or self.special(piece):
            return self._whole(piece)
        return b"".join(map(self.parts.__getitem__, self.find(piece)))

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        first, *rest = _CUT(text)
        return self._first(first) + b"".join(map(self.pieces.__getitem__, rest))

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all of them end to end; no text is null.

        Pieces are numbered by one dictionary of those held and those of these texts, so a piece costs a look-up
        in Arrow and only a new one is ever a Python string. Texts with white space behind a space, or with a
        space at their end, are cut one by one.
        """
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, self.dtype)
        odd = pc.match_substring_regex(texts, _ODD)
        single = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = pc.split_pattern(pc.if_else(odd, "", texts) if len(single) else texts, " ")
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        pieces = cut.flatten()
        firsts = [self._first(x) for x in pieces.take(pa.array(starts)).to_pylist()]
        for k in single.tolist():
            firsts[k] = self.encode(texts[k].as_py())
        # two chunks with one dictionary, so that neither is copied
        numbered = pa.chunked_array([self.held, pieces]).dictionary_encode().chunks[-1]
        del cut, pieces
        known, codes = numbered.dictionary, numbered.indices.to_numpy().copy()
        del numbered
        own = len(known)  # where the texts' first pieces begin, and behind them the end
        sizes, ids = self._joined(map(self.new, self._strings(known[len(self.held) :])), firsts, [b"" if end is None else np.array([end], self.dtype).tobytes()])
        codes[starts] = own + np.arange(len(texts))
        codes = np.insert(codes, np.r_[starts[1:], len(codes)], own + len(texts))
        per_text, out = self._spread(codes, sizes, ids, starts + np.arange(len(texts)))
        self._hold(known, sizes[:own], ids[: int(sizes[:own].sum())], codes)
        return per_text, out

    @staticmethod
    def _strings(pieces: pa.Array) -> Iterator[str]:
        for a in range(0, len(pieces), SPAN):
            yield from pieces[a : a + SPAN].to_pylist()

    def _joined(self, *more: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the pieces held and of more, SPAN of which are Python objects at once."""
        sizes, ids = [self.sizes], [self.ids]
        all_ = chain(*more)
        while some := list(islice(all_, SPAN)):
            sizes.append(np.fromiter(map(len, some), np.int64, len(some)) // self.dtype.itemsize)
            ids.append(np.frombuffer(b"".join(some), self.dtype))
        return np.concatenate(sizes), np.concatenate(ids)

    @staticmethod
    def _spread(codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all pieces in turn; only SPAN pieces have their places spelled out at once."""
        at = np.cumsum(sizes) - sizes
        n = sizes.astype(np.int32 if len(ids) < 1 << 31 else np.int64)[codes]
        per_text = np.add.reduceat(n, starts, dtype=np.int64)
        out = np.empty(int(per_text.sum()), ids.dtype)
        done = 0
        for a in range(0, len(codes), SPAN):
            some = n[a : a + SPAN]
            ends = np.cumsum(some, dtype=np.int64)
            place = np.repeat(at[codes[a : a + SPAN]] - (ends - some), some)
            place += np.arange(len(place))
            out[done : done + len(place)] = ids.take(place)
            done += len(place)
        return per_text, out

    def _hold(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> None:
        """Keeps all pieces, or when they are too many those that were used last: three quarters of a table, or what was just used."""
        last = np.zeros(len(pieces) + 1, np.int32)
        last[: len(self.last)] = self.last
        self.turn += 1
        last[np.minimum(codes, len(pieces))] = self.turn
        last = last[:-1]
        keep = pc.less_equal(pc.utf8_length(pieces), LONGEST).to_numpy(zero_copy_only=False)
        if len(pieces) > TABLE:
            up_to_age = np.cumsum(np.bincount(self.turn - last[keep], minlength=1))
            keep &= last >= self.turn - max(0, int(np.searchsorted(up_to_age, TABLE * 3 // 4, "right")) - 1)
        if keep.sum() > TABLE:
            return self._forget()
        if not keep.all():
            pieces, ids, sizes, last = pieces.filter(pa.array(keep)), ids[np.repeat(keep, sizes)], sizes[keep], last[keep]
        self.held, self.sizes, self.ids, self.last = pieces, sizes, ids, last
