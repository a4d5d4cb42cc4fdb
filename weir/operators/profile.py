"""Profiles of I/O traces. traces: (op, second, bytes, checked_bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024


def peak(traces: DataFrame, seconds: int, op: str = "write", checked: bool = False) -> DataFrame:
    """The bytes of the fullest window, aligned to the epoch, and how many windows there are.

    checked: of the bytes that were verified; null if any of the operation's traces does not say them.
    """
    own = traces.where(F.col("op") == op)
    size = "checked_bytes" if checked else "bytes"
    sums = own.groupBy(F.floor(F.col("second") / seconds).alias("w")).agg(F.sum(size).alias("b"), F.count_if(F.col(size).isNull()).alias("unknown"))
    most = F.coalesce(F.max("b"), F.lit(0))
    return sums.agg(F.when(F.coalesce(F.sum("unknown"), F.lit(0)) == 0, most).alias("peak_bytes"), F.count("*").alias("windows"))


def completion_peak(traces: DataFrame, seconds: int, op: str = "write", checked: bool = False) -> DataFrame:
    """The same as MiB a second."""
    return peak(traces, seconds, op, checked).select((F.col("peak_bytes") / seconds / MIB).alias("mib_per_second"))


def percentiles(df: DataFrame, group: str, value: str, percent: int) -> DataFrame:
    """For each group the values at the floor index percent * (n - 1) div 100 and at the nearest rank
    ceil(n * percent / 100), not interpolated. A value's ranks follow from how often each value occurs, so
    only one row for each distinct value is sorted."""
    by = df.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    up = by.withColumn("hi", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    low, near = F.expr(f"({percent} * (n - 1)) div 100"), F.expr(f"greatest((n * {percent} + 99) div 100 - 1, 0)")
    inside = lambda k: (k < F.col("hi")) & (k >= F.col("hi") - F.col("c"))
    return up.groupBy(group).agg(F.max("n").alias("n"), F.max(F.when(inside(low), F.col(value))).alias("floor_index"), F.max(F.when(inside(near), F.col(value))).alias("nearest_rank"))


def profile(traces: DataFrame) -> DataFrame:
    """Totals of each operation; checked bytes are null if any checked read does not say them."""
    missing = F.count_if(F.col("checked_bytes").isNull())
    return traces.groupBy("op").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.when(missing == 0, F.sum("checked_bytes")).alias("checked_bytes")
    )


def full_profile(traces: DataFrame) -> DataFrame:
    """The same with the share of all bytes, the hosts, and the 99th percentile of sizes at the floor index."""
    sums = profile(traces).join(traces.groupBy("op").agg(F.count_distinct("host").alias("hosts")), "op")
    total = traces.agg(F.sum("bytes").alias("all_bytes"))
    p99 = percentiles(traces, "op", "bytes", 99).select("op", F.col("floor_index").alias("p99"))
    return sums.join(p99, "op").join(F.broadcast(total)).withColumn("share", F.col("bytes") / F.col("all_bytes")).drop("all_bytes")


def report(work: DataFrame, fanout: int) -> DataFrame:
    """One row for a benchmark of workers (role, worker, bytes, seconds): totals, MiB a second by the slowest worker of
    each role, and whether every byte written was read `fanout` times."""
    of = lambda role, c: F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    slowest = lambda role: F.max(F.when(F.col("role") == role, F.col("seconds")))
    rate = lambda role: of(role, "bytes") / MIB / slowest(role)
    sums = work.agg(
        of("write", "bytes").alias("written"), of("read", "bytes").alias("read"), rate("write").alias("write_mib_s"), rate("read").alias("read_mib_s"),
        F.count_distinct("worker").alias("workers"),
    )
    return sums.withColumn("balanced", F.col("read") == F.col("written") * fanout)


def ring(items: DataFrame, position: str, readers: int, hosts: int) -> DataFrame:
    """Who reads what: reader r of a host takes the positions r, r + readers, ... of the host before it."""
    return items.withColumn("rank", F.pmod(F.col(position), F.lit(readers))).withColumn("producer", F.pmod(F.col("host") - 1, F.lit(hosts)))


def loads(sizes: DataFrame, position: str, size: str, each: int) -> DataFrame:
    """Sums of `each` consecutive publications."""
    return sizes.groupBy(F.expr(f"{position} div {each}").alias("load")).agg(F.count("*").alias("publications"), F.sum(size).alias("bytes"))
