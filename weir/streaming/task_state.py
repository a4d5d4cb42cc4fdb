"""The task state machine over a raw stream, in which events may be stale: those of an attempt that does not
hold the task are dropped, as an admitted log would never have them.

Transactions must arrive in order from batch to batch (within a batch they are sorted): one that comes after a
later one of its task is dropped as stale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "task_id string, state string, failures int, attempt string, seq bigint"
STATE = "state string, failures int, max_attempts int, attempt string, seq bigint"
NEW = (None, 0, 0, None, -1)


def step(now: tuple, e: dict) -> tuple:
    """The state after an event: (state, failures, max_attempts, attempt, seq)."""
    state, failures, most, attempt, seq = now
    kind, own = e["type"], e.get("attempt")
    held = state == "leased" and own == attempt
    if kind == "Submitted" and state is None:
        return "pending", 0, int(e["max_attempts"]), None, e["seq"]
    if kind == "Leased" and state == "pending":
        return "leased", failures, most, own, e["seq"]
    if kind == "Cancelled" and state in ("pending", "leased"):
        return "cancelled", failures, most, attempt, e["seq"]
    if not held:
        return now
    if kind == "Completed":
        return "completed", failures, most, attempt, e["seq"]
    if kind == "Yielded":
        return "pending", failures, most, None, e["seq"]
    if kind == "Failed" and not e["retryable"]:
        return "failed", failures, most, attempt, e["seq"]
    if kind in ("Failed", "Expired", "EpochRevoked"):
        return ("pending" if failures + 1 < most else "failed"), failures + 1, most, None, e["seq"]
    return now


def _fold(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(group.get) if group.exists else NEW
    events = pd.concat(list(frames)).sort_values(["seq", "idx"])
    names = list(events.columns)
    for row in events.itertuples(index=False, name=None):
        e = dict(zip(names, row, strict=True))
        if e["seq"] > now[4] or now[0] is None:
            now = step(now, e)
    group.update(now)
    yield pd.DataFrame([(key[0], now[0], now[1], now[3], now[4])], columns=["task_id", "state", "failures", "attempt", "seq"])


def task_states(events: DataFrame) -> DataFrame:
    """events (seq, idx, type, task_id, retryable, max_attempts, attempt): each task's state after each batch."""
    return events.groupBy("task_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
