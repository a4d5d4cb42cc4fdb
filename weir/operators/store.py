"""Record sets: publication, manifests, digests, validation and packs.

records: (pub, ordinal, record_id, bytes, tokens, codec, ...); edges: (pub, dep).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from weir.errors import InvalidReference
from weir.functions.canon import canonical_json, frame_end, sha256_hex
from weir.sources.kept import kept

from .reach import reaching


def record_checksums(blobs: DataFrame, id: str, payload: str) -> DataFrame:
    data = F.col(payload).cast("binary")
    return blobs.select(id, F.octet_length(data).cast("bigint").alias("length"), sha256_hex(data).alias("checksum"))


def read_record(refs: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """Payloads of refs whose checksum holds; `intact` is false where it does not."""
    return refs.join(records, key).withColumn("intact", sha256_hex(F.col("payload")) == F.col("checksum"))


def read(records: DataFrame, pub) -> DataFrame:
    """A set's own records in manifest order; dependencies are not followed."""
    return records.where(F.col("pub") == pub).orderBy("ordinal")


def usage(records: DataFrame) -> DataFrame:
    return records.groupBy("pub").agg(F.count("*").alias("records"), F.sum("bytes").alias("payload_bytes"), F.sum("tokens").alias("tokens"))


def result_usage(records: DataFrame, edges: DataFrame, levels: int = 64) -> DataFrame:
    """Bytes and tokens with those of dependencies, a shared one counted each time; records are a set's own.

    One join for each level of dependencies. Of the paths to a dependency only the number is kept. A graph with
    a cycle has no end and is refused after `levels`.
    """
    own = usage(records)
    step = own.select(F.col("pub").alias("top"), "pub", F.lit(1).cast("bigint").alias("paths"))
    reached = step
    for _ in range(levels):
        step = kept(step.join(edges, "pub").groupBy("top", F.col("dep").alias("pub")).agg(F.sum("paths").alias("paths")))
        if step.isEmpty():
            break
        reached = reached.union(step)
    else:
        raise ValueError("dependencies go on without end")
    sums = reached.join(own.drop("records"), "pub").groupBy("top").agg(*[F.sum(F.col("paths") * F.col(c)).alias(c) for c in ("payload_bytes", "tokens")])
    return own.select("pub", "records").join(sums.withColumnRenamed("top", "pub"), "pub")


def _ordered(value: Column) -> Column:
    """The values of a set in manifest order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("ordinal"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def manifest(records: DataFrame) -> DataFrame:
    return records.groupBy("pub").agg(_ordered(F.col("record_id")).alias("records"))


def _lines(records: DataFrame) -> Column:
    """Each record's envelope as canonical JSON; checksum and metadata belong to it where records have them."""
    names = [c for c in ("record_id", "bytes", "tokens", "codec", "checksum", "metadata") if c in records.columns]
    return canonical_json({c: F.col(c) for c in names})


def _digest(lines: Column, dependencies: Column) -> Column:
    return sha256_hex(F.concat(F.lit('{"dependencies":['), F.array_join(dependencies, ","), F.lit('],"records":['), F.array_join(lines, ","), F.lit("]}")))


def _sets(records: DataFrame) -> DataFrame:
    """All that validation asks of a set's own records, in one aggregation."""
    marks = [F.min(F.struct(c)).alias(f"least_{c}") for c in _MARKS if c in records.columns] + [F.max(F.struct(c)).alias(f"most_{c}") for c in _MARKS if c in records.columns]
    return records.groupBy("pub").agg(
        F.count("*").alias("records"), F.sum("bytes").alias("payload_bytes"), F.sum("tokens").alias("tokens"),
        (F.count_distinct("record_id") == F.count("*")).alias("unique"), _ordered(_lines(records)).alias("lines"), *marks,
    )


def logical_digest(records: DataFrame, edges: DataFrame | None = None, levels: int = 64) -> DataFrame:
    """(pub, digest, records): a digest of what the set holds and depends on and in which order, whatever pack it is
    in. edges: (pub, dep, ord); a dependency enters by its own digest, so digests are made level by level."""
    own = _sets(records).select("pub", "records", "lines")
    none = F.array().cast("array<string>")
    if edges is None:
        return own.select("pub", _digest(F.col("lines"), none).alias("digest"), "records")
    own, needs = kept(own), edges.groupBy("pub").agg(F.count("*").alias("needs"))
    todo = kept(own.join(needs, "pub", "left").fillna({"needs": 0}))
    done = kept(todo.where("needs = 0").select("pub", _digest(F.col("lines"), none).alias("digest"), "records"))
    for _ in range(levels):
        todo = kept(todo.join(done, "pub", "left_anti"))
        if todo.isEmpty():
            return done
        met = edges.join(done.select(F.col("pub").alias("dep"), "digest"), "dep").groupBy("pub")
        met = met.agg(F.count("*").alias("met"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "digest"))), lambda d: F.concat(F.lit('"'), d["digest"], F.lit('"'))).alias("deps"))
        ready = todo.join(met, "pub").where("met = needs").select("pub", _digest(F.col("lines"), F.col("deps")).alias("digest"), "records")
        done = kept(done.unionByName(ready))
    raise InvalidReference("dependencies are missing or go on without end")


#: Marks of the task and attempt that made a record; those of a set's records are its descriptor's.
_MARKS = ("task_id", "attempt_id")


def validate(records: DataFrame, descriptors: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Descriptors (pub, records, payload_bytes, tokens, digest) that do not fit, with the first reason.

    One aggregation of the records says all, but for the digests of sets with dependencies: these come from
    logical_digest. Where descriptors and records both have task_id or attempt_id, those must agree.
    """
    real = _sets(records)
    if digests is None:
        real = real.withColumn("digest", _digest(F.col("lines"), F.array().cast("array<string>")))
    else:
        real = real.join(digests.select("pub", "digest"), "pub", "left")
    d, r = descriptors.alias("d"), real.drop("lines").alias("r")
    foreign = F.lit(False)
    for c in _MARKS:
        if c in descriptors.columns and c in records.columns:
            foreign = foreign | ~F.col(f"r.least_{c}.{c}").eqNullSafe(F.col(f"d.{c}")) | ~F.col(f"r.most_{c}.{c}").eqNullSafe(F.col(f"d.{c}"))
    reason = (
        F.when(F.col("r.pub").isNull(), "missing")
        .when(~F.col("r.unique"), "repeated")
        .when(F.col("d.records") != F.col("r.records"), "records")
        .when(foreign, "foreign")
        .when(~F.col("d.digest").eqNullSafe(F.col("r.digest")), "digest")
        .when((F.col("d.payload_bytes") != F.col("r.payload_bytes")) | (F.col("d.tokens") != F.col("r.tokens")), "usage")
    )
    return d.join(r, "pub", "left").select("pub", reason.alias("reason")).where("reason IS NOT NULL")


def validate_closure(records: DataFrame, descriptors: DataFrame, edges: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The same, and sets (reason "dependency") that reach one that does not fit or that is not described."""
    own = kept(validate(records, descriptors, digests))
    nowhere = edges.select(F.col("dep").alias("node")).join(descriptors.select(F.col("pub").alias("node")), "node", "left_anti")
    links = edges.select(F.col("pub").alias("parent"), F.col("dep").alias("child"))
    tainted = reaching(own.select(F.col("pub").alias("node")).unionByName(nowhere), links).select(F.col("node").alias("pub"))
    tainted = tainted.join(descriptors.select("pub"), "pub", "left_semi")
    return tainted.join(own, "pub", "left").select("pub", F.coalesce("reason", F.lit("dependency")).alias("reason"))


def record_set(refs: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """A manifest over records that exist: refs (pub, ordinal, key) with their envelopes, `found` false where none is."""
    return refs.join(envelopes(records).drop("pub", "ordinal").withColumn("_in", F.lit(True)), key, "left").withColumn("found", F.col("_in").isNotNull()).drop("_in")


def metrics(records: DataFrame, publications: DataFrame) -> DataFrame:
    """One row for a store: records, their bytes, segments, publications (seconds each) and the time they took."""
    sums = records.agg(F.count("*").alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("payload_bytes"))
    return sums.join(publications.agg(F.count_distinct("segment").alias("segments"), F.count("*").alias("publications"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("publish_seconds")))


def envelopes(records: DataFrame, codec: str | None = None) -> DataFrame:
    """Members without their payloads; ordinals stay those of the whole set."""
    bare = records.drop("payload")
    return bare if codec is None else bare.where(F.col("codec") == codec)


def boundaries(frames: DataFrame) -> DataFrame:
    """frames (segment, ordinal, offset, envelope, length) that do not begin where the one before ends."""
    w = Window.partitionBy("segment").orderBy("ordinal")
    end = frame_end(F.col("offset"), F.col("envelope"), F.col("length"))
    return frames.withColumn("expected", F.lag(end).over(w)).where("expected IS NOT NULL AND expected <> offset").select("segment", "ordinal", "expected", "offset")


def pack_rotation(publications: DataFrame, target: int, writer: str = "writer", order: str = "seq", size: str = "size") -> DataFrame:
    """(writer, seq, pack): a writer begins a new pack when the current one is not empty and would pass the
    target; 0 is a pack for each publication.

    The reset depends on the running size, so each writer's rows are passed in order with two numbers of state.
    """
    names = [writer, order, "pack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pack, used = object(), 0, 0
        for b in batches:
            out = []
            for w, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if w != of:
                    of, pack, used = w, 0, 0
                if used > 0 and (target == 0 or used + s > target):
                    pack, used = pack + 1, 0
                used += s
                out.append(pack)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=names)

    rows = publications.select(writer, F.col(order).cast("bigint").alias(order), F.col(size).cast("bigint").alias("_size"))
    schema = StructType(rows.schema.fields[:2]).add("pack", LongType())
    return rows.repartition(writer).sortWithinPartitions(writer, order).mapInArrow(run, schema)


def publication_receipts(results: DataFrame) -> DataFrame:
    """The latest result of each (writer, api, submission)."""
    return results.groupBy("writer", "api", "submission_id").agg(F.max_by("result", "seq").alias("result"), F.max("seq").alias("seq"))


def unfinished(log: DataFrame) -> DataFrame:
    """Publications (writer, submission_id) that began and were not done."""
    begun, done = log.where("event = 'begin'"), log.where("event = 'done'")
    return begun.join(done.select("writer", "submission_id"), ["writer", "submission_id"], "left_anti").select("writer", "submission_id").distinct()


def unfinished_writers(log: DataFrame) -> DataFrame:
    """Writers with publications that began and were not done, and how many."""
    return unfinished(log).groupBy("writer").agg(F.count("*").alias("open"))


def retire_writer(log: DataFrame, whole: DataFrame, writer, policy: str = "recover", discard_staging: bool = False) -> DataFrame:
    """What retiring a writer does with its unfinished publications: (submission_id, action).

    whole: (submission_id) of those whose records are all there. "recover" completes these and drops the others;
    "abandon" drops all. With discard_staging the finished ones that nobody took over are released too.
    """
    if policy not in ("recover", "abandon"):
        raise ValueError(f"no such policy: {policy}")
    mine = unfinished(log).where(F.col("writer") == writer).join(whole.select("submission_id", F.lit(True).alias("whole")).distinct(), "submission_id", "left")
    out = mine.select("submission_id", F.when(F.col("whole") & F.lit(policy == "recover"), "complete").otherwise("drop").alias("action"))
    if discard_staging:
        done = log.where((F.col("writer") == writer) & (F.col("event") == "done")).select("submission_id").distinct()
        out = out.unionByName(done.select("submission_id", F.lit("release").alias("action")))
    return out
