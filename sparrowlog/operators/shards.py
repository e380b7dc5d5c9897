"""Shards, rounds, selection and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Ordering

ID = ["topic", "part", "off"]


def dedup(log: DataFrame) -> DataFrame:
    """One row for each record, which topic, partition and offset name."""
    return log.dropDuplicates(ID)


def shard_sizes(log: DataFrame, ordering: Ordering) -> DataFrame:
    return log.groupBy(*ordering.columns).agg(F.count("*").alias("n"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


def rounds(log: DataFrame, ordering: Ordering) -> DataFrame:
    """The round in which each record runs if nothing fails: its place in its shard; without order, all run in the first."""
    if ordering is Ordering.UNORDERED:
        return log.withColumn("round", F.lit(1).cast("long"))
    w = Window.partitionBy(*ordering.columns).orderBy("off")
    return log.withColumn("round", F.row_number().over(w).cast("long"))


def rounds_with_retries(log: DataFrame, ordering: Ordering, fails: str = "fails") -> DataFrame:
    """``start_round`` and ``done_round`` of each record when its first ``fails`` attempts fail; a failing head holds up its shard."""
    if ordering is Ordering.UNORDERED:
        start = F.lit(1).cast("long")
    else:
        w = Window.partitionBy(*ordering.columns).orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.col(fails) + 1).over(w), F.lit(0)).cast("long") + 1
    return log.withColumn("start_round", start).withColumn("done_round", F.col("start_round") + F.col(fails))


def after_round(log: DataFrame, ordering: Ordering, r: int, fails: str = "fails") -> DataFrame:
    """The work after round ``r``: ``attempts`` failed so far and whether each record has ``succeeded``."""
    done = rounds_with_retries(log, ordering, fails)
    attempts = F.greatest(F.lit(0), F.least(F.col(fails), F.lit(r) - F.col("start_round") + 1)).cast("long")
    return done.withColumn("succeeded", F.col("done_round") <= r).withColumn("attempts", attempts)


def eligible(work: DataFrame, ordering: Ordering, available: str = "true") -> DataFrame:
    """Records that may be taken: not succeeded, available, and in an ordered shard its first one; an unavailable head blocks its shard."""
    todo = work.where(~F.col("succeeded"))
    if ordering is not Ordering.UNORDERED:
        w = Window.partitionBy(*ordering.columns).orderBy("off")
        todo = todo.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return todo.where(available)


def scan(work: DataFrame, ordering: Ordering, available: str = "true", epochs: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """What a scan of all shards may take.

    Stale entries (of another epoch) are dropped and the scan goes on; in a
    partition that is blocked (``state``: highest_succeeded, allowed) only records
    below the highest succeeded offset are taken, and the first one that is not
    ends the scan of its shard.
    """
    if epochs is not None:
        work = work.join(epochs.select("topic", "part", "epoch"), ["topic", "part", "epoch"], "left_semi")
    if state is None:
        return eligible(work, ordering, available)
    s = state.select("topic", "part", F.col("highest_succeeded").alias("top"), "allowed")
    out = eligible(work, ordering, available).join(s, ["topic", "part"], "left")
    return out.where("coalesce(allowed, true) or off < top").drop("top", "allowed")


def open_shards(work: DataFrame, ordering: Ordering) -> DataFrame:
    """The shards that are kept: under KEY order one without open work is dropped, other orders keep theirs."""
    per = work.groupBy(*ordering.columns).agg(F.expr("count_if(not succeeded)").alias("open"))
    return per.where("open > 0") if ordering is Ordering.KEY else per


def natural_order(work: DataFrame) -> DataFrame:
    """Work by topic, partition as a number, and offset."""
    return work.orderBy(*ID)


def take_fair(candidates: DataFrame, ordering: Ordering, n: int, resume: int = 0) -> DataFrame:
    """The first ``n`` candidates going round the shards from number ``resume`` on; adds ``turn`` from 1.

    Shards are numbered in order of their columns: within a topic's partition by a
    window over one row a shard, and after all shards of partitions before it, of
    which there is a row each.  The ``n`` rows come from a top-n that each task makes
    of its own.
    """
    names = ordering.columns
    distinct = candidates.select(*names).distinct()
    parts = distinct.groupBy("topic", "part").agg(F.count("*").alias("own"))  # a row a partition: small
    every = Window.orderBy("topic", "part")
    parts = parts.select("topic", "part", (F.sum("own").over(every) - F.col("own")).alias("before"), F.sum("own").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_shards"))
    place = F.row_number().over(Window.partitionBy("topic", "part").orderBy(*names)) - 1
    count = distinct.withColumn("place", place).join(parts, ["topic", "part"]).select(*[F.col(c).alias(f"shard_{c}") for c in names], (F.col("before") + F.col("place")).alias("seq"), "n_shards")
    same = [F.col(c).eqNullSafe(F.col(f"shard_{c}")) for c in names]
    placed = candidates.join(count, same).select(*candidates.columns, F.expr(f"pmod(seq - {resume}, n_shards)").alias("visit"))
    top = placed.orderBy("visit", "off").limit(n)
    return top.withColumn("turn", F.row_number().over(Window.orderBy("visit", "off")).cast("long")).drop("visit")


def batches(log: DataFrame, size: int) -> DataFrame:
    """``batch``: consecutive runs of at most ``size`` records of a partition, the last may be short."""
    w = Window.partitionBy("topic", "part").orderBy("off")
    return log.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def batch_failures(batched: DataFrame, failed: Column) -> DataFrame:
    """``batch_failed``: a record that fails takes its batch with it."""
    w = Window.partitionBy("topic", "part", "batch")
    return batched.withColumn("batch_failed", F.max(failed).over(w))


def request(target: int, out: int, batch_size: int = 1) -> int:
    """Records to ask for so that ``target`` are in flight, topped up to whole batches."""
    want = max(0, target - out)
    return want + (-want) % batch_size


def requests(state: DataFrame, target: int, batch_size: int = 1, out: str = "in_flight") -> DataFrame:
    """``wanted``: the same for rows that tell how many are in flight."""
    want = F.greatest(F.lit(0), F.lit(target) - F.col(out))
    return state.withColumn("wanted", (want + F.pmod(-want, F.lit(batch_size))).cast("long"))


def awaiting_selection(work: DataFrame, now_us: int) -> DataFrame:
    """(topic, part, ready, waiting): open work whose retry is due, and all open work; ``retry_due`` is null for what never failed."""
    return work.where("not succeeded").groupBy("topic", "part").agg(F.expr(f"count_if(retry_due is not null and retry_due <= {now_us})").alias("ready"), F.count("*").alias("waiting"))
