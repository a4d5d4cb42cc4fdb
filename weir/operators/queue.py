"""The work queue as queries over its state tables.

tasks: (task_id, state, priority, scheduling_key, pending_order, control, ...); commits: (position,
submission_id, task_id, digest, records, bytes, tokens, worker).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def in_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("priority"), "scheduling_key", "pending_order")


def acquire(tasks: DataFrame, limit: int, control: bool = False, ids: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """The pending tasks that a worker is given next; ids is a set, however often an id stands in it."""
    free = tasks.where((F.col("state") == "pending") & (F.col("control") == control))
    if prefix is not None:
        free = free.where(F.col("task_id").cast("string").startswith(prefix))
    if ids is not None:
        free = free.join(ids.select("task_id"), "task_id", "left_semi")
    return in_order(free).limit(limit)


def pending(tasks: DataFrame, prefix: str | None = None, min_priority: int | None = None) -> DataFrame:
    """All pending tasks, control tasks too."""
    out = tasks.where(F.col("state") == "pending")
    if prefix is not None:
        out = out.where(F.col("task_id").cast("string").startswith(prefix))
    return out if min_priority is None else out.where(F.col("priority") >= min_priority)


def submit_conflicts(tasks: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of a batch that the queue has or that stand in it twice."""
    twice = batch.groupBy("task_id").agg(F.count("*").alias("n"))
    known = tasks.select("task_id", F.lit(True).alias("known"))
    return twice.join(known, "task_id", "left").where("known OR n > 1").select("task_id", F.when(F.col("known"), "known").otherwise("repeated").alias("reason"))


def after_failure(tasks: DataFrame) -> DataFrame:
    """tasks (failures, max_attempts, retryable) with the state that one more failure leaves."""
    again = F.col("retryable") & (F.col("failures") + 1 < F.col("max_attempts"))
    return tasks.withColumn("next_state", F.when(again, "pending").otherwise("failed"))


def expired(tasks: DataFrame, now: float) -> DataFrame:
    """Leases that ended by now; a lease without a deadline never does."""
    return tasks.where((F.col("state") == "leased") & (F.col("deadline") <= now))


def histogram(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"))


def commits_page(commits: DataFrame, cursor: int, limit: int) -> DataFrame:
    if limit <= 0:
        raise ValueError("a page has one commit at least")
    return commits.where((F.col("position") >= cursor) & (F.col("position") < cursor + limit))


def commits_end(commits: DataFrame, tasks: DataFrame, sealed: bool, cursor: int) -> DataFrame:
    """One row: how many commits there are, and whether a reader at cursor has seen the last one ever."""
    n = commits.agg(F.count("*").alias("n"))
    open_ = tasks.agg(F.count_if(~F.col("state").isin(*TERMINAL)).alias("open"))
    return n.join(open_).select("n", (F.lit(sealed) & (F.col("n") == cursor) & (F.col("open") == 0)).alias("end_of_input"))


def accepted_once(submissions: DataFrame) -> DataFrame:
    """submissions (submission_id, seq, digest): the first is accepted, a repeat with its digest gets the same
    receipt and any other digest is a conflict."""
    w = Window.partitionBy("submission_id").orderBy("seq")
    first = F.first("digest").over(w)
    verdict = F.when(F.row_number().over(w) == 1, "accepted").when(F.col("digest") == first, "receipt").otherwise("conflict")
    return submissions.withColumn("verdict", verdict)


def accounting(commits: DataFrame, tasks: DataFrame, processed_cursor: int, processed: DataFrame) -> DataFrame:
    """One row: what was accepted and not yet processed, and what leased tasks may add."""
    left = commits.where(F.col("position") >= processed_cursor).join(processed, "position", "left_anti")
    sums = left.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("accepted_records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("accepted_bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("accepted_tokens"))
    leased = tasks.where("state = 'leased'").agg(
        F.count_if(~F.col("control")).alias("inflight"), F.count_if(F.col("control")).alias("control_inflight"),
        F.coalesce(F.sum(F.when(~F.col("control"), F.col("estimated_bytes"))), F.lit(0)).alias("estimated_bytes"),
    )
    return sums.join(leased).withColumn("total_bytes", F.col("accepted_bytes") + F.col("estimated_bytes"))


def worker_receipts(commits: DataFrame, last_leases: DataFrame, worker: int) -> DataFrame:
    """Accepted receipts of a worker: completed tasks keep their last lease."""
    return commits.join(last_leases.where(F.col("worker") == worker).select("task_id"), "task_id", "left_semi")


def progress_errors(progress: DataFrame, processed: int, fetch: int) -> DataFrame:
    """Acknowledged positions outside [processed, fetch) or given twice."""
    w = Window.partitionBy("consumer", "position")
    return progress.withColumn("n", F.count("*").over(w)).where((F.col("position") < processed) | (F.col("position") >= fetch) | (F.col("n") > 1)).drop("n")


def missing_dependencies(required: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """What a checkpoint must depend on and does not."""
    return required.join(edges.where(F.col("parent") == checkpoint).select(F.col("child").alias("root")), "root", "left_anti")


def missing_dependencies_of_each(required: DataFrame, edges: DataFrame) -> DataFrame:
    """Of (checkpoint, root), what a checkpoint must depend on and does not, for all checkpoints at once."""
    return required.join(edges.select(F.col("parent").alias("checkpoint"), F.col("child").alias("root")), ["checkpoint", "root"], "left_anti")


def latest_continuation(progress: DataFrame) -> DataFrame:
    """The last continuation that each task saved."""
    return progress.groupBy("task_id").agg(F.max("generation").alias("generation"), F.max_by("input_ref", "generation").alias("input_ref"))
