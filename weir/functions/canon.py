"""Scalar functions: digests of canonical JSON, checked counters, byte spans and name syntax."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.kept import kept

U64_MAX = 2**64 - 1


def sha256_hex(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys that keeps nulls. Fields must not be floating point."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(fields: Mapping[str, Column]) -> Column:
    return sha256_hex(canonical_json(fields))


def checked_add(a: Column, b: Column) -> Column:
    """The sum as an unsigned 64-bit counter, or null if it does not fit."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.when((a >= 0) & (b >= 0) & (total <= F.lit(str(U64_MAX)).cast("decimal(20,0)")), total.cast("decimal(20,0)"))


def valid_counter(x: Column) -> Column:
    """Whether text is a whole number that an unsigned 64-bit counter holds."""
    n = F.when(x.rlike("^[0-9]{1,20}$"), x.try_cast("decimal(20,0)"))
    return F.coalesce(n <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), F.lit(False))


def authenticated_span(start: Column, stop: Column, chunk: Column, length: Column) -> Column:
    """The chunk-aligned cover of [start, stop): struct(first, last) in bytes; an empty range has an empty
    cover and an invalid one is null."""
    first = start - F.pmod(start, chunk)
    last = F.least(length, stop + F.pmod(-stop, chunk))
    valid = (chunk > 0) & (start >= 0) & (start <= stop) & (stop <= length)
    return F.when(valid & (start == stop), F.struct(start.alias("first"), start.alias("last"))).when(valid, F.struct(first.alias("first"), last.alias("last")))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def frame_end(offset: Column, envelope: Column, payload: Column) -> Column:
    """Where a frame ends: twelve bytes of lengths, envelope and payload."""
    return offset + F.lit(12).cast("bigint") + envelope + payload


def plain_path(path: Column) -> Column:
    """Relative, without empty, `.` or `..` parts and without back slashes."""
    return F.coalesce(path.rlike(r"^[^/\\\x00]+(/[^/\\\x00]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False))


def hex_key(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def request_key(operation: Column, id: Column) -> Column:
    """The JSON pair that names a request, or null if the id does not have 1 to 1024 bytes."""
    return F.when(F.octet_length(id).between(1, 1024), F.to_json(F.array(operation, id)))


def same_layout(shape: Column, dtype: Column, nbytes: Column, want_shape: Column, want_dtype: Column, want_nbytes: Column) -> Column:
    return shape.eqNullSafe(want_shape) & dtype.eqNullSafe(want_dtype) & nbytes.eqNullSafe(want_nbytes)


def first_occurrences(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


#: A row's number within its partition is in the lower bits of what monotonically_increasing_id gives.
_ROW_BITS = 33


def positions(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with the number, from 0, of each row in a total order.

    Rows are dealt by ranges of the order, sorted and written once with their partition and row: counts and
    numbers are both read from what was written, so they agree however Spark plans either. Only one count for
    each partition is added up in one place.
    """
    at = "_at"
    while at.lower() in {c.lower() for c in df.columns}:
        at += "_"
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, _ROW_BITS).alias("_part")
    counts = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_before")))  # one row for each partition
    numbered = dealt.join(starts, F.shiftright(at, _ROW_BITS) == F.col("_part"))
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)).alias(into))
