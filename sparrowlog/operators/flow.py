"""Flow control: when to ask for more, and how a load factor moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loaded(queued: int, out: int, target: int, factor: int) -> bool:
    return queued + out > target * factor


def load_states(state: DataFrame, target: int, factor: int) -> DataFrame:
    """``loaded`` for rows of (queued, out)."""
    return state.withColumn("loaded", F.col("queued") + F.col("out") > target * factor)


@dataclass
class LoadFactor:
    """Goes up a step when work runs low, never down; only once more than ``warm_up`` seconds have gone, and more than ``cool_down`` since the last step."""

    factor: int = 2
    most: int = 100
    step: int = 1
    warm_up: float = 2.0
    cool_down: float = 2.0
    started: float = 0.0
    stepped: float | None = None

    def offer(self, now: float, queue_low: bool, last_fulfilled: bool) -> bool:
        if not (queue_low and last_fulfilled) or now - self.started <= self.warm_up or self.factor >= self.most:
            return False
        if self.stepped is not None and now - self.stepped <= self.cool_down:
            return False
        self.factor, self.stepped = min(self.most, self.factor + self.step), now
        return True


@dataclass
class RateLimiter:
    """Lets an action run at most once a period; the first call always does."""

    period: float
    last: float | None = None

    def allow(self, now: float) -> bool:
        if self.last is not None and now - self.last < self.period:
            return False
        self.last = now
        return True
