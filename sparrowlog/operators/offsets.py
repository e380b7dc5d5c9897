"""Progress of each partition: what has been seen, what succeeded, what may be committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NO_OFFSET

PARTITION = ["topic", "part"]


def partition_state(work: DataFrame) -> DataFrame:
    """A row for each partition, from work with ``off`` and ``succeeded``; one aggregate, without lists.

    Offsets that were never received are no gaps: only received ones count.
    """
    todo, ok = "not succeeded", "succeeded"
    agg = work.groupBy(*PARTITION).agg(
        F.max("off").alias("highest_seen"),
        F.coalesce(F.expr(f"max(off) FILTER (WHERE {ok})"), F.lit(NO_OFFSET)).cast("long").alias("highest_succeeded"),
        F.expr(f"count(*) FILTER (WHERE {todo})").alias("incompletes"),
        F.expr(f"min(off) FILTER (WHERE {todo})").alias("lowest_incomplete"),
    )
    sequential = F.coalesce(F.col("lowest_incomplete") - 1, F.col("highest_succeeded"))
    return agg.withColumn("sequential", sequential).withColumn("to_commit", sequential + 1)


def incompletes(work: DataFrame) -> DataFrame:
    return work.where("not succeeded").select(*PARTITION, "off")


def incompletes_below_highest(work: DataFrame) -> DataFrame:
    """Incomplete offsets below the highest succeeded one: what a commit has to encode."""
    top = work.where("succeeded").groupBy(*PARTITION).agg(F.max("off").alias("highest_succeeded"))
    return incompletes(work).join(top, PARTITION).where("off < highest_succeeded").select(*PARTITION, "off")


def dirty_commits(payloads: DataFrame, committed: DataFrame) -> DataFrame:
    """The payloads (topic, part, to_commit, metadata, payload) that differ from the last commit (topic, part, committed, metadata).

    A success above the lowest incomplete offset moves no offset but changes the
    payload, so it counts.  An ack that comes between a commit's collection and its
    confirmation differs from what was collected, so the partition stays dirty.
    Where both have the whole ``payload``, it decides: metadata that was too long
    and left out looks alike before and after an ack.
    """
    by = "payload" if "payload" in payloads.columns and "payload" in committed.columns else "metadata"
    last = committed.select(*PARTITION, "committed", F.col(by).alias("was"))
    changed = payloads.join(last, PARTITION, "left").where(f"committed is null or to_commit <> committed or not {by} <=> was")
    return changed.select(payloads.columns)


def in_flight(work: DataFrame) -> DataFrame:
    """Records out for processing, by partition."""
    return work.groupBy(*PARTITION).agg(F.expr("count_if(in_flight)").alias("in_flight"))


def previously_completed(records: DataFrame, state: DataFrame, todo: DataFrame) -> DataFrame:
    """``completed``: at or below the highest succeeded offset and not incomplete; by joins, as lists of incompletes may be long."""
    s = state.select(*PARTITION, "highest_succeeded")
    t = todo.select(*PARTITION, "off").distinct().withColumn("open", F.lit(True))
    return records.join(s, PARTITION, "left").join(t, [*PARTITION, "off"], "left").withColumn("completed", F.coalesce(F.col("off") <= F.col("highest_succeeded"), F.lit(False)) & F.col("open").isNull()).drop("highest_succeeded", "open")


def replay(records: DataFrame, state: DataFrame, todo: DataFrame) -> DataFrame:
    """Records that a restart still has to run."""
    return previously_completed(records, state, todo).where("not completed").drop("completed")


def takeable(records: DataFrame, state: DataFrame) -> DataFrame:
    """Records of partitions that take more, and of blocked ones those below the highest succeeded; state has ``allowed``."""
    s = state.select(*PARTITION, "highest_succeeded", "allowed")
    return records.join(s, PARTITION).where("allowed or off < highest_succeeded").drop("highest_succeeded", "allowed")
