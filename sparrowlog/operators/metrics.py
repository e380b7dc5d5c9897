"""Meters as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import METADATA_LIMIT, Options, Ordering
from .offsets import partition_state


def slow_work(work: DataFrame, now_us: int, after_us: int = 10_000_000) -> DataFrame:
    """Records in flight for longer than the threshold, by partition."""
    return work.where(f"in_flight and {now_us} - taken_us > {after_us}").groupBy("topic", "part").agg(F.count("*").alias("slow"))


def by_partition(work: DataFrame) -> DataFrame:
    return work.groupBy("topic", "part").agg(
        F.expr("count_if(succeeded)").alias("processed"), F.sum("attempts").alias("failed"), F.expr("count_if(not succeeded)").alias("incomplete"),
        F.expr("coalesce(max(off) FILTER (WHERE succeeded), -1)").alias("highest_completed"), F.max("off").alias("highest_seen"),
    )


def overall(work: DataFrame, ordering: Ordering) -> DataFrame:
    """Shards are counted by one partial aggregate a shard, not by a distinct over all rows."""
    per = work.groupBy(*ordering.columns).agg(F.count("*").alias("n"), F.expr("count_if(not succeeded)").alias("open"))
    parts = per.groupBy("topic", "part").agg(F.sum("n").alias("n"), F.sum("open").alias("open"), F.count("*").alias("shards"), F.max("n").alias("largest"))
    return parts.agg(F.sum("shards").alias("shards"), F.sum("n").alias("records"), F.sum("open").alias("incomplete"), F.count("*").alias("partitions"), F.max("largest").alias("largest_shard"))


def encoder(chosen: DataFrame) -> DataFrame:
    """Use of each encoding and the share of the metadata that it takes; chosen has ``encoding`` and ``chars``."""
    return chosen.groupBy("encoding").agg(F.count("*").alias("used"), F.sum("chars").alias("chars"), (F.max("chars") / F.lit(METADATA_LIMIT)).alias("most_space_used"))


#: Meters and what they are of: the processor, a partition, or an encoding.
METERS = {
    "processor": ("user.function.processing.time", "dynamic.load.factor", "status", "inflight.records", "waiting.records", "poller.status", "partitions.paused", "shards", "incomplete.offsets.total", "shards.size", "partitions.number", "offsets.encoding.time"),
    "partition": ("processed.records", "failed.records", "slow.records", "incomplete.offsets", "highest.completed", "highest.sequential.succeeded", "highest.seen", "latest.committed", "assignment.epoch", "metadata.space.used", "payload.ratio.used"),
    "encoding": ("offsets.encoding.usage",),
}


def meters(work: DataFrame, ordering: Ordering, payloads: DataFrame, epochs: DataFrame, options: Options, status: int = 1, factor: int = 2, paused: int = 0, now_us: int | None = None, instance: str = "") -> DataFrame:
    """(meter, tags, value): every meter, from work (succeeded, attempts, in_flight, took_us, taken_us) and what partitions commit.

    ``tags`` has the options' tags, the instance, and the topic and partition or the
    encoding that a meter is of.  The ratio of a payload to its range is null where the range is empty.
    """
    common = {**options.tags, "instance": instance}
    fixed = F.create_map(*(F.lit(x) for kv in common.items() for x in kv))
    after, now = int(options.slow_after * 1e6), now_us if now_us is not None else 0
    state = partition_state(work).select("topic", "part", "sequential")
    per = work.groupBy("topic", "part").agg(
        F.expr("count_if(succeeded)").alias("processed"), F.sum("attempts").alias("failed"), F.expr("count_if(not succeeded)").alias("incomplete"), F.expr("count_if(in_flight)").alias("flying"),
        F.expr(f"count_if(in_flight and {now} - taken_us > {after})").alias("slow"), F.expr("coalesce(max(off) FILTER (WHERE succeeded), -1)").alias("completed"), F.max("off").alias("seen"), F.sum("took_us").alias("took"),
    )
    c = payloads.select("topic", "part", "to_commit", "highest_succeeded", "chars", "encoding", "encoding_us")
    per = per.join(state, ["topic", "part"]).join(c, ["topic", "part"], "left").join(epochs.select("topic", "part", "epoch"), ["topic", "part"], "left")
    own = F.map_concat(fixed, F.create_map(F.lit("topic"), F.col("topic"), F.lit("partition"), F.col("part").cast("string")))
    columns = ("processed", "failed", "slow", "incomplete", "completed", "sequential", "seen", "to_commit", "epoch", f"chars / {METADATA_LIMIT}", "try_divide(chars, highest_succeeded - to_commit)")
    by_part = per.select(own.alias("tags"), F.inline(F.array(*(F.struct(F.lit(m).alias("meter"), F.expr(x).cast("double").alias("value")) for m, x in zip(METERS["partition"], columns, strict=True)))))
    shard = work.groupBy(*ordering.columns).agg(F.count("*").alias("n")).agg(F.count("*").alias("shards"), F.sum("n").alias("records"))
    total = per.agg(F.sum("took").alias("took"), F.sum("flying").alias("flying"), F.sum("incomplete").alias("incomplete"), F.count("*").alias("parts"), F.sum("encoding_us").alias("encoding_us")).crossJoin(shard)  # one row each
    columns = ("took / 1e6", str(factor), str(status), "flying", "incomplete - flying", str(status), str(paused), "shards", "incomplete", "records", "parts", "encoding_us / 1e6")
    of_all = total.select(fixed.alias("tags"), F.inline(F.array(*(F.struct(F.lit(m).alias("meter"), F.expr(x).cast("double").alias("value")) for m, x in zip(METERS["processor"], columns, strict=True)))))
    used = c.where("encoding is not null").groupBy("encoding").agg(F.count("*").cast("double").alias("value"))
    used = used.select(F.map_concat(fixed, F.create_map(F.lit("encoding"), F.col("encoding"))).alias("tags"), F.lit(METERS["encoding"][0]).alias("meter"), "value")
    return by_part.unionByName(of_all).unionByName(used).select("meter", "tags", "value")


def observed(acks: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The acks of a run, and its meters once an action has read them: no pass of their own."""
    seen = Observation(name)
    return acks.observe(
        seen, F.expr("count_if(ok)").alias("processed.records"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("failed.records"),
        (F.coalesce(F.sum("took_us"), F.lit(0)) / 1e6).alias("user.function.processing.time"), F.expr("count_if(not ok)").alias("waiting.records"),
    ), seen


class Registry:
    """Meters by name and tags, as a process keeps them: made once, read, and closed together."""

    def __init__(self, tags: dict[str, str] | None = None):
        self.tags, self._held = dict(tags or {}), {}

    def _key(self, meter: str, tags: dict) -> tuple:
        return meter, tuple(sorted({**self.tags, **tags}.items()))

    def add(self, meter: str, value: float, **tags: str) -> None:
        key = self._key(meter, tags)
        self._held[key] = self._held.get(key, 0.0) + value

    def set(self, meter: str, value: float, **tags: str) -> None:
        self._held[self._key(meter, tags)] = value

    def get(self, meter: str, **tags: str) -> float | None:
        return self._held.get(self._key(meter, tags))

    def remove(self, meter: str, **tags: str) -> None:
        self._held.pop(self._key(meter, tags), None)

    def close(self) -> None:
        self._held.clear()
