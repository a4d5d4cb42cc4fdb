"""The commit log and the traces as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def accepted(events: DataFrame) -> DataFrame:
    """The commits of an admitted log. Its writer lets each submission in once and a transaction is one file, so no
    state is needed to accept it once."""
    return events.where("type = 'Completed'").select("submission_id", "task_id", "digest", "seq", "idx")


def accepted_raw(events: DataFrame, time: str, lateness: str) -> DataFrame:
    """The same of events that nobody admitted: a repeat within `lateness` is dropped, and state ends with it."""
    return accepted(events.withWatermark(time, lateness).where("type = 'Completed'").dropDuplicatesWithinWatermark(["submission_id"]))


def traffic(traces: DataFrame, seconds: int, lateness: str = "30 seconds") -> DataFrame:
    """Bytes of each operation in windows aligned to the epoch."""
    at = traces.withColumn("ts", F.timestamp_seconds("second")).withWatermark("ts", lateness)
    return at.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "op").agg(F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "op", "bytes")


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, exactly once, into Parquet."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
