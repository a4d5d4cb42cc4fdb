"""Publication of record sets and tensors as Parquet, once for each submission."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.errors import IdempotencyConflict, InvalidReference
from weir.functions.canon import sha256_hex
from weir.sources.kept import kept

from .store import logical_digest
from .tensors import ITEM_BYTES

#: Bytes of a tensor that one checksum covers.
CHUNK = 4 * 1024 * 1024


def publish_many(records: DataFrame, folder: str, submission_id: str, edges: DataFrame | None = None) -> DataFrame:
    """Writes sets (pub, ordinal, record_id, payload, codec, tokens) in one job; (pub, digest, records).

    edges (pub, dep, ord) say which sets of this call each depends on, or earlier ones by (pub, dep, ord, dep_digest).
    Record ids are unique in a call. A repeated submission gets its first receipt; other content, or other
    dependencies, under its name is a conflict.
    """
    spark = records.sparkSession
    full = records.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("checksum", sha256_hex(F.col("payload")))
    path = f"{folder}/submission={submission_id}"
    n, distinct = full.agg(F.count("*"), F.count_distinct("record_id")).first()
    if n == 0 or n != distinct:
        raise ValueError("a publication has records, and their ids differ")
    sets = kept(logical_digest(full, edges))
    if before := _receipts(spark, path):
        same = sets.select("pub", "digest").join(before.select("pub", "digest"), ["pub", "digest"], "left_semi").count()
        if not same == sets.count() == before.count():
            raise IdempotencyConflict(submission_id)
        return before
    full.write.mode("overwrite").parquet(f"{path}/records")  # over what an attempt that did not end left
    if edges is not None:
        edges.write.mode("overwrite").parquet(f"{path}/edges")
    sets.write.mode("overwrite").parquet(f"{path}/sets")  # its success file is the commit
    return _receipts(spark, path)


def publish_tensors(spark: SparkSession, tensors: dict[str, np.ndarray], folder: str, submission_id: str, prefix: str = "", pub: int = 0) -> DataFrame:
    """Publishes arrays as one set, each under prefix:name; the arrays are the driver's own."""
    rows = [tensor_record(f"{prefix}:{name}" if prefix else name, array) | {"pub": pub, "ordinal": k, "tokens": 0} for k, (name, array) in enumerate(tensors.items())]
    schema = "pub bigint, ordinal bigint, record_id string, payload binary, codec string, tokens bigint, shape array<bigint>, dtype string, nbytes bigint, chunk bigint, digests array<string>"
    return publish_many(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), folder, submission_id)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(submission_id, path) of the publications below a folder that were committed; begun ones are not listed."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{folder}/submission=*/sets/_SUCCESS")
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or []
    paths = [str(f.getPath().getParent().getParent().toString()) for f in found]  # one for each submission
    return spark.createDataFrame([(p.rsplit("submission=", 1)[1], p) for p in sorted(paths)], "submission_id string, path string")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A JSON report, whole or not at all: written beside its place and renamed."""
    jvm = spark.sparkContext._jvm
    attempt, place = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}", path))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(attempt)
    out.write(bytearray(json.dumps(report, sort_keys=True, allow_nan=False).encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(attempt, place)


def emit(traces: DataFrame, folder: str) -> None:
    """Adds traces, as JSON lines, to those that event_log.traces reads."""
    traces.write.mode("append").json(folder)


def _receipts(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/sets/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.parquet(f"{path}/sets")


def read_published(spark: SparkSession, folder: str, submission_id: str, pub, verify: bool = False) -> DataFrame:
    """A set's records in order; with verify a damaged one raises when it is read."""
    path = f"{folder}/submission={submission_id}"
    if _receipts(spark, path) is None:
        raise InvalidReference(submission_id)
    rows = spark.read.parquet(f"{path}/records").where(F.col("pub") == pub)
    if verify:
        rows = rows.withColumn("payload", F.when(sha256_hex(F.col("payload")) == F.col("checksum"), F.col("payload")).otherwise(F.raise_error(F.lit("damaged record")).cast("binary")))
    return rows.orderBy("ordinal")


def tensor_record(name: str, array: np.ndarray, chunk: int = CHUNK) -> dict:
    """A record of an array: little-endian bytes with a digest for each chunk."""
    if array.dtype.name not in ITEM_BYTES:
        raise TypeError(f"no such element type: {array.dtype}")
    if array.ndim > 16:
        raise ValueError("more than 16 dimensions")
    data = np.ascontiguousarray(array).astype(array.dtype.newbyteorder("<")).tobytes()
    digests = [hashlib.sha256(data[k : k + chunk]).hexdigest() for k in range(0, len(data), chunk)]
    return {"record_id": name, "payload": data, "codec": "tensor.v1", "shape": list(array.shape), "dtype": array.dtype.name, "nbytes": len(data), "chunk": chunk, "digests": digests}
