"""Queue state as a query over its event log: every task's state at once, without a sequential loop.

events: (seq, idx, type, task_id, retryable, max_attempts, worker, priority, scheduling_key). Types: Submitted,
Leased, Expired, Failed, EpochRevoked, Cancelled, Yielded, TaskProgress, Completed. The log is an admitted
one: its writer checked every lease (for raw input see streaming/task_state.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions.canon import positions

_RETRY = ("Expired", "EpochRevoked")


def replay(events: DataFrame) -> DataFrame:
    """(task_id, state, failures, lease_worker, generation, last_seq) of each task.

    A retry keeps its place in the queue and costs an attempt; a yield costs none and goes to the tail
    (see pending_order). Completed, cancelled and finally failed tasks keep their last lease.
    """
    at = F.struct("seq", "idx")
    retry = F.col("type").isin(*_RETRY) | ((F.col("type") == "Failed") & F.coalesce("retryable", F.lit(False)))
    moving = F.col("type") != "TaskProgress"
    got = events.groupBy("task_id").agg(
        F.count_if(retry).alias("failures"),
        F.max_by(F.when(moving, F.struct("type", retry.alias("retry"))), F.when(moving, at)).alias("last"),
        F.max_by(F.when(F.col("type") == "Leased", F.col("worker")), F.when(F.col("type") == "Leased", at)).alias("worker"),
        F.count_if(F.col("type") == "Leased").alias("generation"),
        F.max(F.when(F.col("type") == "Submitted", F.col("max_attempts"))).alias("max_attempts"),
        F.max(F.when(moving, F.col("seq"))).alias("last_seq"),
    )
    kind = F.col("last.type")
    state = (
        F.when(kind.isin("Submitted", "Yielded"), "pending")
        .when(kind == "Leased", "leased")
        .when(kind == "Completed", "completed")
        .when(kind == "Cancelled", "cancelled")
        .when(~F.col("last.retry"), "failed")
        .when(F.col("failures") < F.col("max_attempts"), "pending")
        .otherwise("failed")
    )
    held = ~(kind.isin("Submitted", "Yielded") | F.col("last.retry"))
    return got.select("task_id", state.alias("state"), "failures", F.when(held, F.col("worker")).alias("lease_worker"), "generation", "last_seq")


def pending_order(events: DataFrame) -> DataFrame:
    """(task_id, pending_order): the number of its last Submitted or Yielded among all of these events."""
    queued = events.where(F.col("type").isin("Submitted", "Yielded")).select("seq", "idx", "task_id")
    return positions(queued, ["seq", "idx"], "at").groupBy("task_id").agg(F.max("at").alias("pending_order"))


def commit_positions(events: DataFrame) -> DataFrame:
    return positions(events.where(F.col("type") == "Completed").select("seq", "idx", "task_id"), ["seq", "idx"], "position")
