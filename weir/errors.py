"""What operations raise. The names and what they derive from are fixed: callers of such a queue catch them."""


class QueueError(RuntimeError):
    """The base of all; itself for what the queue's state forbids, as a submission after the seal."""


class LeaseExpired(QueueError):
    """A lease whose time is over."""


class StaleAttempt(QueueError):
    """An attempt, or a consumer's token, that does not hold what it asks for."""


class IdempotencyConflict(QueueError):
    """Other content under an id that has an answer already."""


class IndeterminateCommit(QueueError):
    """A transaction that may have been written or not: the log was not told."""


class StorageUnavailable(QueueError):
    """Storage failed: no task is taken or given out until the queue is opened again."""


class QuotaExceeded(StorageUnavailable):
    """The log's file system is full."""


class CorruptData(QueueError):
    """A log with a gap or a line that cannot be read."""


class InvalidReference(QueueError):
    """A result, batch, publication or commit that is not there, or no longer."""


class UnsafeRecovery(QueueError):
    """What would lose data: a root that is not retained, a report that changed, a second owner."""


class WriterFenced(QueueError):
    """Another writer has the transaction."""
