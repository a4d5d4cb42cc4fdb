"""Token ids of documents in compressed binary files, in ascending order of document id.

A folder holds `table` (the shared frequencies), one file for each range of documents, and `manifest`
(JSON: the files in order, the ids before each, checksums). A file is

    magic, checksum of the table | blocks | documents' ids, lengths and order | checkpoints | sizes, magic

Blocks are coded independently (rans.py). A checkpoint gives a block's offset, length, number of ids, ids
before it in the file, and checksum, so any block of any file can be read alone. Files are written under
the name of an attempt and then renamed, so a task that is run again after a lost executor leaves the same
file. Frequencies are counted over all documents.

Defined cases: a null or empty text has the end id only; documents of one id, and those of a null id, which
come first, are ordered by a hash of their ids; repeated rows are written as often as they occur; an empty
table gives a folder without files; other columns, whatever they are called, are not read. A very long text
is one row, whose ids must fit a task; its blocks are coded one after the other.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .piece_tokens import PieceTokenizer
from .rans import BLOCK, Table, decode, encode
from .shared import shared_dir, slices, written

MAGIC = b"WEIRTOK1"
#: Ids that a file is meant to hold.
FILE_IDS = 8_000_000
#: Bytes of texts that are encoded at once, unless one alone is longer.
SLICE = 1 << 23
_IDS = ["id", "n", "ids", "counts"]
_CHECKPOINT = np.dtype([("offset", "<u8"), ("size", "<u8"), ("n", "<u8"), ("before", "<u8"), ("crc", "<u4")])
_DOCUMENT = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<u8")])
_TAIL = struct.Struct("<QQ8s")

_TOKENIZERS: dict[str, PieceTokenizer] = {}


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _save(uri: str, data: bytes) -> None:
    fs, path = _place(uri)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as f:
        f.write(data)
    fs.move(attempt, path)


def _load(uri: str) -> bytes:
    fs, path = _place(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def token_ids(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int | None = None) -> DataFrame:
    """(id, n, ids, counts) for each row: ids in little-endian binary of the width that the vocabulary needs.

    Each task adds one more row, of which only counts is not null: how often it met each id, in 64 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, PieceTokenizer(path))
        counts = np.zeros(max(t.size, (end or 0) + 1), np.int64)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for at, to in slices(texts, SLICE):
                n, ids = t.encode_all(texts.slice(at, to - at), end)
                pa.default_memory_pool().release_unused()  # else it stays with a worker that later stages use as well
                counts += np.bincount(ids, minlength=len(counts))
                ends = np.r_[0, np.cumsum(n)] * t.dtype.itemsize
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(n, pa.int64()), rows.cast(pa.binary()), pa.nulls(len(n), pa.binary())], names=_IDS)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=_IDS)

    return docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id bigint, n bigint, ids binary, counts binary")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most `size` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                counts += np.frombuffer(x.as_buffer(), "<i8")
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["s", "c"])

    out = np.zeros(size, np.int64)
    for r in ids.select("counts").where("counts IS NOT NULL").mapInArrow(run, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c")).collect():
        out[r.s] = r.c
    return out


class _File:
    """Gathers documents into blocks and then into one file."""

    def __init__(self, table: Table, width: int) -> None:
        self.table, self.kind = table, np.dtype(f"<u{width}")
        self.out = io.BytesIO()
        self.out.write(MAGIC + struct.pack("<I", table.crc()))
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.points: list[tuple] = []
        self.docs: list[tuple] = []

    def add(self, id: int | None, raw: bytes) -> None:
        ids = np.frombuffer(raw, self.kind)
        self.docs.append((id is not None, id or 0, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 8 * BLOCK:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        stop = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, stop, BLOCK):
            own = ids[a : min(a + BLOCK, stop)]
            data = encode(own, self.table)
            self.points.append((self.out.tell(), len(data), len(own), self.n, zlib.crc32(data)))
            self.out.write(data)
            self.n += len(own)
        self.held, self.n_held = [ids[stop:].copy()], len(ids) - stop

    def close(self) -> bytes:
        self.flush(True)
        docs, points = np.array(self.docs, _DOCUMENT), np.array(self.points, _CHECKPOINT)
        index = zlib.compress(docs.tobytes())
        self.out.write(index + points.tobytes())
        self.out.write(struct.pack("<I", zlib.crc32(index + points.tobytes())))
        self.out.write(_TAIL.pack(len(index), len(points), MAGIC))
        return self.out.getvalue()


def write(docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text", end: int | None = 2) -> str:
    """Writes the folder and returns it. path: the tokenizer's file, which every executor must have."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    tokenizer = PieceTokenizer(path)
    width, size = tokenizer.dtype.itemsize, max(tokenizer.size, (end or 0) + 1)
    del tokenizer
    stored = written(token_ids(docs, path, id, text, end))
    counts = id_counts(stored, size)
    fs, top = _place(folder)
    fs.create_dir(top, recursive=True)
    if not counts.sum():
        _save(f"{folder}/manifest", json.dumps({"width": width, "files": []}).encode())
        return folder
    table = Table.of_counts(counts)
    _save(f"{folder}/table", table.to_bytes())
    shared = sc.broadcast(table.to_bytes())  # four bytes for each id of the vocabulary
    n_files = max(1, min(-(-int(counts.sum()) // FILE_IDS), 1 << 20))
    n_files = max(n_files, min(sc.defaultParallelism, int(counts.sum()) // 1_000_000))
    ordered = stored.where("counts IS NULL").drop("counts").withColumn("tie", F.xxhash64("ids")).repartitionByRange(n_files, "id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = None
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if file is None:
                    file = _File(Table.from_bytes(shared.value), width)
                file.add(i, x.as_buffer())
        if file is not None:
            data = file.close()
            name = f"part-{part:06d}"
            _save(f"{folder}/{name}", data)
            row = {"part": [part], "name": [name], "n": [file.n], "docs": [len(file.docs)], "size": [len(data)], "crc": [zlib.crc32(data)]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int64()), ("name", pa.string()), ("n", pa.int64()), ("docs", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())]))

    rows = ordered.mapInArrow(run, "part bigint, name string, n bigint, docs bigint, size bigint, crc bigint").collect()  # one for each file
    files, before = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        files.append(r.asDict() | {"before": before})
        before += r.n
    _save(f"{folder}/manifest", json.dumps({"width": width, "files": files}).encode())
    return folder


class TokenFile:
    """One file, read block by block."""

    def __init__(self, uri: str, table: Table) -> None:
        fs, path = _place(uri)
        self.f, self.table = fs.open_input_file(path), table
        end = self.f.size()
        index, points, magic = _TAIL.unpack(self.f.read_at(_TAIL.size, end - _TAIL.size))
        head = self.f.read_at(len(MAGIC) + 4, 0)
        if magic != MAGIC or head != MAGIC + struct.pack("<I", table.crc()):
            raise ValueError(f"{uri} is not a token file of this table")
        size = index + points * _CHECKPOINT.itemsize
        raw = self.f.read_at(size + 4, end - _TAIL.size - 4 - size)
        if struct.unpack("<I", raw[size:])[0] != zlib.crc32(raw[:size]):
            raise ValueError(f"{uri}: the index is damaged")
        self.docs = np.frombuffer(zlib.decompress(raw[:index]), _DOCUMENT)
        self.points = np.frombuffer(raw[index:size], _CHECKPOINT)

    def block(self, k: int) -> np.ndarray:
        p = self.points[k]
        data = self.f.read_at(int(p["size"]), int(p["offset"]))
        if zlib.crc32(data) != p["crc"]:
            raise ValueError(f"block {k} is damaged")
        return decode(data, int(p["n"]), self.table)

    def spans(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document, some of its ids, whether they are its last); each document has one span at least."""
        lengths = self.docs["n"].astype(np.int64)
        k = done = 0
        for b in range(len(self.points)):
            ids, at = self.block(b), 0
            while k < len(lengths):
                take = min(int(lengths[k]) - done, len(ids) - at)
                full = done + take == lengths[k]
                yield k, ids[at : at + take], full
                at, done = at + take, done + take
                if not full:
                    break
                k, done = k + 1, 0
        for rest in range(k, len(lengths)):  # of no ids
            yield rest, np.zeros(0, np.uint32), True


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n, crc) of each document, as decoded from the files: crc of its ids in 32 bits each."""
    schema = "id bigint, start bigint, n bigint, crc bigint"
    manifest = json.loads(_load(f"{folder}/manifest"))
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(f["name"], f["before"]) for f in manifest["files"]], "name string, before bigint").repartition(len(manifest["files"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            for name, before in zip(*[c.to_pylist() for c in b.columns], strict=True):
                table = table or Table.from_bytes(_load(f"{folder}/table"))
                f = TokenFile(f"{folder}/{name}", table)
                crcs = np.zeros(len(f.docs), np.int64)
                now = 0
                for k, ids, full in f.spans():
                    now = zlib.crc32(np.ascontiguousarray(ids, "<u4"), now)
                    if full:
                        crcs[k], now = now, 0
                n = f.docs["n"].astype(np.int64)
                starts = before + np.cumsum(n) - n
                ids = pa.array(f.docs["id"].astype(np.int64), mask=f.docs["known"] == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(n), pa.array(crcs)], names=["id", "start", "n", "crc"])

    return files.mapInArrow(run, schema)


def write_and_digest(docs: DataFrame, path: str, folder: str | None = None, id: str = "doc_id", text: str = "text", end: int | None = 2) -> DataFrame:
    spark = docs.sparkSession
    return read_digests(spark, write(docs, folder or shared_dir(spark), path, id, text, end))
