"""Restoring progress after assignment, truncation and compaction; fencing of stale work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..model import ForeignMetadata

PARTITION = ["topic", "part"]


def assign(epochs: DataFrame, assigned: DataFrame, commits: DataFrame) -> DataFrame:
    """(topic, part, epoch, committed, metadata): the epoch of an assigned partition grows by one, from 0; without a commit it starts at -1 with none."""
    e = epochs.groupBy(*PARTITION).agg(F.max("epoch").alias("last"))
    return assigned.select(*PARTITION).distinct().join(e, PARTITION, "left").join(commits, PARTITION, "left").select(*PARTITION, F.coalesce(F.col("last") + 1, F.lit(0)).cast("long").alias("epoch"), F.coalesce("committed", F.lit(-1)).cast("long").alias("committed"), "metadata")


def load(commits: DataFrame, foreign: ForeignMetadata = ForeignMetadata.FAIL) -> tuple[DataFrame, DataFrame]:
    """(state, incompletes) that commits (topic, part, committed, metadata) stand for.

    State is (topic, part, committed, highest_seen).  Metadata that cannot be read
    counts as none: all below the committed offset is done and nothing else is
    known.  That of another kind of consumer fails, or is ignored, as asked.
    """

    @F.pandas_udf("highest_seen long, todo array<long>")
    def run(committed: pd.Series, metadata: pd.Series) -> pd.DataFrame:
        seen, todo = [], []
        for c, m in zip(committed, metadata):
            highest, offs = codec.decode_or_none(int(c), m, foreign)
            seen.append(highest)
            todo.append(np.array(offs, np.int64))  # whole payloads may hold millions
        return pd.DataFrame({"highest_seen": seen, "todo": todo})

    read = commits.select(*PARTITION, "committed", run("committed", "metadata").alias("d"))
    return read.select(*PARTITION, "committed", "d.highest_seen"), read.select(*PARTITION, F.explode("d.todo").alias("off"))


def fence(work: DataFrame, epochs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work of the current epoch, stale work); a partition that was removed makes its work stale."""
    now = epochs.select(*PARTITION, "epoch")
    return work.join(now, [*PARTITION, "epoch"], "left_semi"), work.join(now, [*PARTITION, "epoch"], "left_anti")


def revoke(work: DataFrame, revoked: DataFrame) -> DataFrame:
    return work.join(revoked.select(*PARTITION), PARTITION, "left_anti")


def give_up(work: DataFrame, payloads: DataFrame, epochs: DataFrame, revoked: DataFrame, lost: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits to write first, remaining work, epochs) when partitions go: revoked ones commit what they have, lost ones don't.

    Their epoch grows by one, so results that are still under way are stale.
    """
    gone = revoked.select(*PARTITION).distinct()
    commits = payloads.join(gone, PARTITION, "left_semi")
    went = gone.withColumn("went", F.lit(1))
    moved = epochs.join(went, PARTITION, "left").withColumn("epoch", F.col("epoch") + F.coalesce("went", F.lit(0))).drop("went")
    return commits.limit(0) if lost else commits, revoke(work, gone), moved


def truncate(todo: DataFrame, first_polled: DataFrame) -> DataFrame:
    """Incompletes after the first poll: those below the first offset that the log still has are gone.

    ``first_polled`` (topic, part, first, committed).  A first offset below the committed one means that the log was
    rewound: all state of the partition goes, as everything runs again.
    """
    f = first_polled.select(*PARTITION, "first", "committed")
    return todo.join(f, PARTITION, "left").where("first is null or (first >= committed and off >= first)").select(todo.columns)


def bootstrap(first_polled: DataFrame) -> DataFrame:
    """Where each partition's commit stands after its first poll."""
    return first_polled.select(*PARTITION, F.col("first").alias("to_commit"), F.expr("CASE WHEN first < committed THEN 'rewound' WHEN first > committed THEN 'truncated' ELSE 'as committed' END").alias("outcome"))


def compact(todo: DataFrame, polled: DataFrame) -> DataFrame:
    """Incompletes without those that lie within the polled range but were not polled, as compaction removed them."""
    span = polled.groupBy(*PARTITION).agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    had = polled.select(*PARTITION, "off").distinct().withColumn("there", F.lit(True))
    return todo.join(span, PARTITION, "left").join(had, [*PARTITION, "off"], "left").where("there or lo is null or off < lo or off > hi").select(todo.columns)


def route(results: DataFrame, epochs: DataFrame) -> DataFrame:
    """``outcome`` of each result: stale, ack, requeue, or error where it tells nothing."""
    now = epochs.select(*PARTITION, F.col("epoch").alias("current"))
    return results.join(now, PARTITION, "left").withColumn("outcome", F.expr("CASE WHEN current IS NULL OR current <> epoch THEN 'stale' WHEN ok IS NULL THEN 'error' WHEN ok THEN 'ack' ELSE 'requeue' END")).drop("current")
