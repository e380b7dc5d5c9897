"""Failures and their retries; times are microseconds, and ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shards import ID


def due(work: DataFrame, delay: str = "1000000") -> DataFrame:
    """``retry_due``: last failure and delay (SQL, microseconds); null for records that never failed."""
    return work.withColumn("retry_due", F.expr(f"if(attempts = 0, null, last_failed_us + cast({delay} as bigint))"))


def backoff(base_us: int, factor: float, most_us: int) -> str:
    """SQL for a delay that grows with the attempts so far."""
    return f"least({most_us}, {base_us} * power({factor}, attempts - 1))"


def ready(now_us: int) -> str:
    """SQL: the delay has passed, the very moment included."""
    return f"(attempts = 0 OR retry_due <= {now_us})"


def available(now_us: int) -> str:
    """SQL: not out for processing, not done, and due."""
    return f"(not in_flight AND not succeeded AND {ready(now_us)})"


def queue(failures: DataFrame) -> DataFrame:
    """The newest failure of each record (by ``attempt``), in the order of ``retry_due`` when sorted by it."""
    w = Window.partitionBy(*ID).orderBy(F.desc("attempt"))
    return failures.withColumn("newest", F.row_number().over(w)).where("newest = 1").drop("newest")


def next_retry(work: DataFrame) -> DataFrame:
    """Each partition's failed records, those that are due at ``now_us``, and the earliest time of all."""
    return work.groupBy("topic", "part").agg(F.expr("count_if(retry_due is not null)").alias("waiting"), F.expr("count_if(retry_due <= now_us)").alias("ready"), F.min("retry_due").alias("next_due"))


def split_exhausted(work: DataFrame, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """An extension: (records to retry, dead letters)."""
    return work.where(F.col("attempts") < max_attempts), work.where(F.col("attempts") >= max_attempts)
