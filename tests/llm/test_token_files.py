import json
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import weir.llm.piece_tokens as p
import weir.llm.rans as r
import weir.llm.token_files as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", " a", "a ", "a  b   c", "a \n b\n\nc \t\n d", "x.\nYes.\n\nNo.\r\nSo", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endof text|>",
    "it's we'll 'sabc don''t I'M", "²x x² x²5 Ⅷ", "a\x1cb \x1c c\x85 d\xa0 e", "é è ñandú ß.", "日本語 テスト", "🙂 🙃.🙂", "a1b2 3c ,d .e", "x" * 30_000, "ab " * 60_000,
]


def texts():
    rng = random.Random(4)
    letters = "abcdefgé'’.,!<|>1² \n\t \x1c"
    return ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(1500)]


def test_every_character_is_encoded_as_the_library_does():
    """Each code point alone, behind a letter and before one: Python's tables of letters need not be the library's."""
    lib = Tokenizer.from_file(PATH)
    own = p.PieceTokenizer(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x12500 or c % 97 == 0)]
    for k in range(0, len(points), 40):
        text = " ".join(f"{chr(c)} a{chr(c)} {chr(c)}b.{chr(c)}" for c in points[k : k + 40])
        assert own.encode_all(pa.array([text]))[1].tolist() == lib.encode(text, add_special_tokens=False).ids, points[k]
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, points[k]
    for x in ("a \u0558", "\u0558", "a\u0558 \u088f\u0c5c", "\u1c89", "x" + "\u0558" * 3000 + " y"):
        assert np.frombuffer(own.encode(x), own.dtype).tolist() == lib.encode(x, add_special_tokens=False).ids


def test_pieces_equal_the_library(monkeypatch):
    lib = Tokenizer.from_file(PATH)
    for size in (5, 300_000):
        monkeypatch.setattr(p, "TABLE", size * 10)
        own = p.PieceTokenizer(PATH)
        all_ = [x or "" for x in texts()]
        for x in all_:
            assert np.frombuffer(own.encode(x), own.dtype).tolist() == lib.encode(x, add_special_tokens=False).ids, repr(x)
        for k in range(0, len(all_), 90):
            some = all_[k : k + 90]
            n, ids = own.encode_all(pa.array(["cut off", *some])[1:], 2)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(x, add_special_tokens=False).ids + [2] for x in some]
            assert len(own.held) <= size * 10 and len(own.held) == len(own.sizes) and own.sizes.sum() == len(own.ids)
        assert own.encode_all(pa.array([], pa.string()), 2)[1].tolist() == []


def test_places_of_ids_are_not_all_spelled_out_at_once():
    """What numpy holds beside the texts: codes twice, sizes and ids, but no 64-bit places of all pieces."""
    own = p.PieceTokenizer(PATH)
    some = pa.array(["the of and to " * 1000 + "x"] * 500)
    own.encode_all(some, 2)
    tracemalloc.start()
    n, ids = own.encode_all(some, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [4002] * 500 and len(ids) == n.sum()
    assert peak < 24 * len(ids), peak / len(ids)


def test_pieces_used_lately_are_kept(monkeypatch):
    monkeypatch.setattr(p, "TABLE", 100)
    own = p.PieceTokenizer(PATH)
    common = " ".join(f"word{k}" for k in range(20))
    own.encode_all(pa.array([f"x {common}"]), 2)
    for k in range(30):
        own.encode_all(pa.array([f"x {common}" if k % 2 else "x " + " ".join(f"w{k}n{j}" for j in range(30))]), 2)
        assert len(own.held) <= 100 and len(own.held) == len(own.sizes) and own.sizes.sum() == len(own.ids)
        assert set(common.split()) <= set(own.held.to_pylist())


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000, r.BLOCK])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 999)
    table = r.Table.of_counts(np.bincount(ids, minlength=1000) if n else np.ones(1000, np.int64))
    data = r.encode(ids, table)
    assert (r.decode(data, n, table) == ids).all()
    again = r.Table.from_bytes(table.to_bytes())
    assert (again.symbols == table.symbols).all()


def test_coder_with_one_symbol_and_damage():
    ids = np.full(3000, 7)
    table = r.Table.of_counts(np.bincount(ids, minlength=9))
    assert (r.decode(r.encode(ids, table), 3000, table) == 7).all()
    with pytest.raises(ValueError):
        r.encode(np.array([1]), table)
    ids = np.arange(3000) % 9
    table = r.Table.of_counts(np.bincount(ids))
    with pytest.raises((ValueError, IndexError)):
        r.decode(r.encode(ids, table) + b"\0\0\0\0", 3000, table)


def test_files_hold_the_ids_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "FILE_IDS", 30_000)
    rows = [(i, x, "n") for i, x in enumerate(texts())] + [(3, "again", None), (3, "again", None), (None, "no id", None), (None, None, None)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string").repartition(5)
    folder = t.write(docs, f"file://{tmp_path}/out", PATH)
    got = t.read_digests(spark, folder).collect()
    manifest = json.loads((tmp_path / "out/manifest").read_text())
    assert len(manifest["files"]) > 3
    lib = Tokenizer.from_file(PATH)
    want = {}
    for i, x, _ in rows:
        ids = lib.encode(x or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for g in got:
        have.setdefault(g.id, []).append((g.n, g.crc))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    got.sort(key=lambda g: g.start)
    assert [g.start for g in got] == [0, *np.cumsum([g.n for g in got]).tolist()[:-1]]
    assert [(-1 if g.id is None else g.id) for g in got] == sorted((-1 if i is None else i) for i, _, _ in rows)
    # any block alone
    table = r.Table.from_bytes((tmp_path / "out/table").read_bytes())
    f = t.TokenFile(f"{folder}/{manifest['files'][-1]['name']}", table)
    assert len(f.block(len(f.points) - 1)) == f.points[-1]["n"]
    path = tmp_path / "out" / manifest["files"][0]["name"]
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        t.TokenFile(f"{folder}/{path.name}", table).block(0)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert t.write_and_digest(empty, PATH, f"file://{tmp_path}/none").count() == 0
