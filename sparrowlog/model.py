"""Options, names and schemas of keyed log processing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

#: Stands for "no offset".
NO_OFFSET = -1
#: Characters that a commit's metadata may have, and the share from which a partition takes no more records.
METADATA_LIMIT, PRESSURE = 4096, 0.75


class Ordering(str, Enum):
    UNORDERED = "unordered"
    PARTITION = "partition"
    KEY = "key"

    @property
    def columns(self) -> list[str]:
        """What a shard is grouped by; a null key is a shard as any other."""
        return ["topic", "part", "k"] if self is Ordering.KEY else ["topic", "part"]


class CommitMode(str, Enum):
    ASYNC = "periodic_consumer_asynchronous"
    SYNC = "periodic_consumer_sync"
    TRANSACTION = "periodic_transactional_producer"


class ForeignMetadata(str, Enum):
    FAIL = "fail"
    IGNORE = "ignore"


class Status(int, Enum):
    UNUSED, RUNNING, PAUSED, DRAINING, CLOSING, CLOSED = range(6)


@dataclass(frozen=True)
class Options:
    """The settings of a processor, with their usual values; times in seconds."""

    ordering: Ordering = Ordering.KEY
    commit_mode: CommitMode = CommitMode.ASYNC
    commit_interval: float | None = None
    max_concurrency: int = 16
    batch_size: int = 1
    retry_delay: float = 1.0
    #: Seconds that a failed batch waits, from the batch and its failed attempts; it goes before ``retry_delay``.
    retry_delay_of: Callable | None = None
    #: Seconds after which work counts as slow.
    slow_after: float = 10.0
    send_timeout: float = 10.0
    foreign_metadata: ForeignMetadata = ForeignMetadata.FAIL
    eager_during_commit: bool = False
    shutdown_timeout: float = 10.0
    drain_timeout: float = 30.0
    #: Records that a task holds ready; 0 leaves it to the load factor.
    buffer_size: int = 0
    first_load_factor: int = 2
    most_load_factor: int = 100
    #: Times that a commit which fails is tried again.
    commit_retries: int = 200
    #: Tags of every meter.
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def interval(self) -> float:
        if self.commit_interval is not None:
            return self.commit_interval
        return 0.1 if self.commit_mode is CommitMode.TRANSACTION else 5.0

    @property
    def target(self) -> int:
        """Records that should be in flight."""
        return self.max_concurrency * self.batch_size

    def delay_of(self, batch) -> float:
        """Seconds that a failed batch waits."""
        return max(0.0, float(self.retry_delay_of(batch) if self.retry_delay_of else self.retry_delay))

    def load_factor(self) -> int:
        """The first factor, or the fixed one that a buffer size asks for."""
        return -(-self.buffer_size // self.target) if self.buffer_size else self.first_load_factor

    def validate(self, sink: bool = False, has_sink: bool = True) -> Options:
        if self.max_concurrency < 1 or self.batch_size < 1:
            raise ValueError("max_concurrency and batch_size must be at least 1")
        if self.retry_delay < 0:
            raise ValueError("retry_delay must not be negative")
        if self.eager_during_commit and self.commit_mode is not CommitMode.TRANSACTION:
            raise ValueError("eager processing during a commit needs the transactional mode")
        if sink and not has_sink:
            raise ValueError("producing needs a sink")
        if not 1 <= self.first_load_factor <= self.most_load_factor:
            raise ValueError("load factors must be ordered and at least 1")
        return self
