"""Checked byte ranges and tensor rows.

chunks: (id, chunk, data, digest); tensors: (id, values, width).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions.canon import same_layout, sha256_hex

#: Element types and their sizes in bytes.
ITEM_BYTES = {"uint8": 1, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "float16": 2, "bfloat16": 2, "float32": 4, "float64": 8, "bool": 1}


def chunk_table(blobs: DataFrame, id: str, payload: str, chunk: int) -> DataFrame:
    """(id, chunk, data, digest): a payload is cut within its row, so no chunk's row carries the whole."""
    data = F.col(payload).cast("binary")
    last = F.floor((F.octet_length(data) - 1) / chunk).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(data, k * chunk + 1, F.lit(chunk)))
    cut = blobs.where(F.octet_length(data) > 0).select(id, F.posexplode(parts).alias("chunk", "data"))
    return cut.select(id, F.col("chunk").cast("bigint").alias("chunk"), "data", sha256_hex(F.col("data")).alias("digest"))


def range_chunks(requests: DataFrame, chunk: int) -> DataFrame:
    """requests (id, start, stop) to the chunks that [start, stop) touches; none for an empty range."""
    touched = F.sequence((F.col("start") / chunk).cast("bigint"), ((F.col("stop") - 1) / chunk).cast("bigint"))
    return requests.where("0 <= start AND start < stop").withColumn("chunk", F.explode(touched))


def read_ranges(requests: DataFrame, chunks: DataFrame, id: str, chunk: int) -> DataFrame:
    """The bytes of each request (with a column pos) in order, from touched chunks only, and whether all of
    their digests hold. The join key is the chunk, so nothing else is read."""
    got = range_chunks(requests, chunk).join(chunks, [id, "chunk"])
    ok = (sha256_hex(F.col("data")) == F.col("digest")).alias("ok")
    parts = F.array_sort(F.collect_list(F.struct(F.col("chunk"), F.col("data").cast("string").alias("d"), ok)))  # a cast to text keeps bytes
    whole = got.groupBy("pos", id, "start", "stop").agg(parts.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["d"]), "").cast("binary")
    first = F.element_at("p", 1)["chunk"] * chunk
    data = F.substring(joined, (F.col("start") - first + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return whole.select("pos", id, data.alias("bytes"), F.forall("p", lambda x: x["ok"]).alias("intact"))


def preflight(requests: DataFrame, envelopes: DataFrame, id: str) -> DataFrame:
    """Requests (shape, dtype) whose tensor is not of that layout or not there, before any byte is read."""
    have = envelopes.select(id, F.col("shape").alias("_shape"), F.col("dtype").alias("_dtype"), F.col("nbytes").alias("_nbytes"))
    both = requests.join(have, id, "left")
    item = F.create_map(*[x for k, v in ITEM_BYTES.items() for x in (F.lit(k), F.lit(v))])
    want = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x) * F.try_element_at(item, F.col("dtype"))
    reason = F.when(F.col("_dtype").isNull(), "missing").when(~same_layout(F.col("shape"), F.col("dtype"), want, F.col("_shape"), F.col("_dtype"), F.col("_nbytes")), "layout")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").drop("_shape", "_dtype", "_nbytes")


def from_record_set(records: DataFrame, pubs: DataFrame | None = None) -> DataFrame:
    """The tensors of record sets, by their places among all members; others are left out."""
    mine = records if pubs is None else records.join(pubs.select("pub"), "pub", "left_semi")
    return mine.where("codec = 'tensor.v1'")


def shared(tensors: DataFrame) -> DataFrame:
    """Where each tensor lies, to be read elsewhere without a copy."""
    return tensors.select("pub", "ordinal")


def rows(tensors: DataFrame, values: str, width: int, start: int, count: int) -> DataFrame:
    """A contiguous slice of rows of a tensor that is width entries wide."""
    if start < 0 or count < 0:
        raise ValueError("a slice begins and ends within the tensor")
    return tensors.withColumn(values, F.slice(values, start * width + 1, count * width))


def updated(tensors: DataFrame, changes: DataFrame, id: str, values: str, width: int) -> DataFrame:
    """New tensors with the rows of changes (id, row, new) replaced; the old ones are not touched."""
    new = changes.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("row", "new"))).alias("_new"))
    row = lambda i: (i / width).cast("bigint")
    changed = F.transform(values, lambda v, i: F.coalesce(F.get(F.try_element_at("_new", row(i)), F.pmod(i, F.lit(width))), v))
    return tensors.join(new, id, "left").withColumn(values, F.when(F.col("_new").isNull(), F.col(values)).otherwise(changed)).drop("_new")


def layout_errors(tensors: DataFrame) -> DataFrame:
    """tensors (id, shape, dtype, nbytes) whose bytes are not those of shape and type."""
    item = F.create_map(*[x for k, v in ITEM_BYTES.items() for x in (F.lit(k), F.lit(v))])
    want = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x) * F.try_element_at(item, F.col("dtype"))
    bad = want.isNull() | (want != F.col("nbytes")) | (F.size("shape") > 16) | F.exists("shape", lambda x: x < 0)
    return tensors.withColumn("expected", want).where(bad)


def decode(dtype: str):
    """A pandas UDF from little-endian bytes to an array: of whole numbers for the whole-number types, so that none
    loses a digit, and of doubles for the others, as two-byte floats have no Spark type."""
    if dtype not in ITEM_BYTES:
        raise TypeError(f"no such element type: {dtype}")
    whole = "int" in dtype or dtype == "bool"

    @F.pandas_udf("array<bigint>" if whole else "array<double>")
    def run(raw: pd.Series) -> pd.Series:
        if dtype == "bfloat16":
            return raw.map(lambda b: (np.frombuffer(b, "<u2").astype(np.uint32) << 16).view(np.float32).astype(float))
        kind = np.dtype(dtype).newbyteorder("<")
        return raw.map(lambda b: np.frombuffer(b, kind).astype(np.int64 if whole else float))

    return run
