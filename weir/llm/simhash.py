"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes, each a token (position, value). Two fingerprints that differ in at most two bits
differ in at most two bytes, so they share at least six tokens: the guaranteed minimum of the count filter. A
posting for each single token would be read by N / 256 fingerprints, so the index joins four tokens to a key:
the positions lie in four pairs, two differing bytes spoil two pairs at most, and whoever shares six tokens meets
in one of the six postings that are keyed by two whole pairs. There the shared tokens of each two members are
tallied, those that reach the minimum are kept, and their bits are compared.

Fingerprints are distinct before they are indexed, but near copies crowd: a posting of more than CROWD members
is not tallied. Its members go on to postings keyed by six tokens, where meeting is the minimum and two free
bytes are left, so there are 65,536 members at most whatever the number of rows; they are matched by look-ups
of the 136 near values. Either way a posting gives a spanning set of its links, never all pairs of a group.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
than three words are one shingle; a very long text is read whole, CHUNK shingles at a time; repeated rows have one
fingerprint; a null id is never a component's id unless all ids are null; other columns are not read, whatever
they are called; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .graph import components
from .shared import fresh, written

SHINGLE = 3
SEED = 42
DISTANCE = 2
BYTES = 8
#: Shared positional bytes that a link guarantees.
LEAST_SHARED = BYTES - DISTANCE
#: Pairs of positions, two of which make the key of a posting that is tallied.
PAIRS = [(p, p + 1) for p in range(0, BYTES, 2)]
KEYS = [x + y for x, y in combinations(PAIRS, 2)]
#: Members of a posting that are tallied against each other.
CROWD = 512
#: For each kind of posting of six tokens, the positions that are not part of its key.
FREE = list(combinations(range(BYTES), DISTANCE))
#: The kind of four tokens whose crowded postings each kind of six takes over.
WITHIN = [next(k for k, key in enumerate(KEYS) if not set(key) & set(free)) for free in FREE]
#: A fingerprint of more than one row in so many is joined apart from the others.
HOT = 1000
CHUNK = 16_384


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        starts, ends = [0], [len(line)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()][: len(words) - SHINGLE + 1]
        ends = [*gaps.tolist(), len(line)][SHINGLE - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [fingerprint(x) if x else 0 for x in b.column(1).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64()), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """(id, fp) for each row, and the digest if its column is named."""
    own = [] if digest is None else [F.col(f"`{digest}`").alias("digest")]
    schema = "id bigint, fp bigint" + ", digest string" * len(own)
    return docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"), *own).mapInArrow(_fingerprints, schema)


#: The values that differ in one or two of 16 bits.
_NEAR = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.int64)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """Of pairs with difference x: how many positional bytes agree."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then the bits."""
    x = np.bitwise_xor(a, b)
    return (_shared_bytes(x) >= LEAST_SHARED) & (np.bitwise_count(x.view(np.uint64)) <= DISTANCE)


def _forest(n: int, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n members, given both ways, a spanning set: each member but one of a component, and another
    that was met before it."""
    label = np.arange(n)
    while True:
        new = label.copy()
        for k, o in near:
            np.minimum.at(new, k, label[o])
        new = new[new]
        if (new == label).all():
            break
        label = new
    parent = np.full(n, -1, np.int64)  # towards a neighbour met first, from the component's least member on
    parent[label == np.arange(n)] = -2
    todo = True
    while todo:
        todo = False
        reached = parent != -1
        for k, o in near:
            take = ~reached[k] & reached[o] & (parent[k] == -1)
            if take.any():
                parent[k[take]] = o[take]
                todo = True
    k = np.flatnonzero(parent >= 0)
    return k, parent[k]


def _tallied(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among the members of a posting, by how many tokens each two share."""
    raw = np.ascontiguousarray(members).view(np.uint8).reshape(-1, BYTES)
    shared = np.zeros((len(raw), len(raw)), np.uint8)
    for p in range(BYTES):
        shared += raw[:, p, None] == raw[None, :, p]
    i, j = np.nonzero(shared >= LEAST_SHARED)
    linked = (i != j) & (np.bitwise_count((members[i] ^ members[j]).view(np.uint64)) <= DISTANCE)
    k, o = _forest(len(members), [(i[linked], j[linked])])
    return members[k], members[o]


def _links_of_posting(members: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among distinct fingerprints that agree in all but two bytes."""
    raw = np.ascontiguousarray(members).view(np.uint8).reshape(-1, BYTES)
    i, j = FREE[kind]
    value = raw[:, i].astype(np.int64) | raw[:, j].astype(np.int64) << 8
    at = np.full(1 << 16, -1, np.int64)
    at[value] = np.arange(len(value))
    near = []
    for d in _NEAR:
        other = at[value ^ d]
        k = np.flatnonzero(other >= 0)
        if len(k):
            near.append((k, other[k]))
    k, o = _forest(len(value), near)
    ok = _verified(members[k], members[o])
    return members[k][ok], members[o][ok]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by posting; the last posting of a batch is held until it is complete."""

    def done(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[first, len(kind)])
        two = first[size == 2]
        ok = _verified(fp[two], fp[two + 1]) if len(two) else np.zeros(0, bool)
        a, b = [fp[two][ok]], [fp[two + 1][ok]]
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = fp[s : s + n]
            x, y = _tallied(own) if kind[s] < len(KEYS) else _links_of_posting(own, int(kind[s]) - len(KEYS))
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield done(*[r[:cut] for r in rows])
    if len(held[0]):
        yield done(*held)


def _mask(positions: tuple[int, ...] | set[int]) -> Column:
    m = sum(0xFF << 8 * p for p in positions)
    return F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")


def index(nodes: DataFrame) -> DataFrame:
    """The postings of four tokens: (kind, key, fp)."""
    kinds = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("kind"), F.col("fp").bitwiseAND(_mask(key)).alias("key")) for k, key in enumerate(KEYS)])
    return nodes.select("fp", F.explode(kinds).alias("p")).select("p.kind", "p.key", "fp")


def _finer(crowded: DataFrame) -> DataFrame:
    """Members of crowded postings of four tokens in those postings of six that take these over."""
    own = [F.struct(F.lit(len(KEYS) + k).cast("tinyint").alias("kind"), F.col("fp").bitwiseAND(_mask(set(range(BYTES)) - set(free))).alias("key")) for k, free in enumerate(FREE)]
    of = None
    for kind in range(len(KEYS)):
        mine = F.array(*[own[k] for k in range(len(FREE)) if WITHIN[k] == kind])
        of = F.when(F.col("kind") == kind, mine) if of is None else of.when(F.col("kind") == kind, mine)
    return crowded.select("fp", F.explode(of).alias("p")).select("p.kind", "p.key", "fp")


def _roots(nodes: DataFrame) -> DataFrame:
    """nodes with the least fingerprint (root) of each one's component."""
    postings = index(nodes.select("fp"))
    crowds = written(postings.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("kind", "key"))
    if not crowds.isEmpty():
        finer = _finer(postings.join(crowds, ["kind", "key"], "left_semi"))
        postings = postings.join(crowds, ["kind", "key"], "left_anti").union(finer)
    links = postings.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_links, "a bigint, b bigint")
    root = components(links, "a", "b").select(F.col("node").alias("fp"), "root")
    return nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component, copies) for each row of docs: component is the least id reachable over links."""
    fps = written(fingerprints(docs, id, text))
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    rooted = _roots(nodes)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    found = written(rooted.join(least, "root").select("fp", "component", "copies"))
    rows = found.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(found.where(F.col("copies") > rows // HOT))  # fewer than HOT of them hold as many rows each
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(found, "fp")
    return fps.join(hot, "fp").unionByName(rest).select("id", "fp", "component", "copies")


def _digest(text: Column) -> Column:
    """SHA-256 of a text; that of a null text is blank."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate component: the one with the least id, null after all others.

    A row is known by its id and its text's digest: rows that share an id, or have none, are apart when their
    texts are. Among a component's rows of the least id the least digest stays, and one row of those that
    agree in both.
    """
    mine, own, like, times = (fresh(docs, c) for c in ("_near_id", "_near_text", "_near_like", "_near_n"))
    marked = docs.withColumn(own, _digest(F.col(f"`{text}`")))
    fps = fingerprints(marked, id, text, own)
    same = fps.groupBy("fp", "id", "digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "n"))
    nodes = written(same.groupBy("fp").agg(first.alias("first")))
    stay = _roots(nodes).groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.id").alias(mine), F.col("first.digest").alias(like), F.col("first.n").alias(times))
    # sorted at every size: whether the ids happen to be few enough to broadcast says nothing of larger inputs
    kept = marked.join(stay.hint("merge"), F.col(f"`{id}`").cast("bigint").eqNullSafe(F.col(mine)) & (F.col(own) == F.col(like)))
    again = kept.where(F.col(times) > 1).dropDuplicates([mine, own])
    return kept.where(F.col(times) == 1).unionByName(again).drop(mine, own, like, times)
