"""Streams with an ack for every record.

Spark's checkpoint keeps how far the source has been read; which records of it
are finished is kept in a ledger.  Each micro-batch has a folder of acks and one
of state: finished offsets as runs, and the records that are still open.  The next
batch reads the newest state only, so its cost goes with what is open and with
what is new, not with the length of the stream.  A batch counts once its mark is
written, last of all; one that is delivered again replaces its own folders.  So
outputs, acks and commits of a batch are there together, and once.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..model import CommitMode, Options, Status
from ..operators import offsets, reconcile, shards
from ..plans.runner import HISTORY, Processor

ID, PARTITION = shards.ID, offsets.PARTITION
COMMITS = "topic string, part int, to_commit long, highest_succeeded long, metadata string, encoding string, chars int, encoding_us long, allowed boolean, payload string"


class Ledger:
    """Under ``path``: acks, runs, open and commits, each with a folder for every micro-batch, and marks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))

    def _names(self, kind: str) -> list[str]:
        p = self._at(kind)
        return [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _batches(self, kind: str) -> list[int]:
        return sorted(int(x.removeprefix("batch=")) for x in self._names(kind) if x.startswith("batch="))

    def last(self) -> int:
        """The last batch that counts, as do all before it; -1 if there is none."""
        return max((int(x) for x in self._names("marks")), default=-1)

    def mark(self, batch: int) -> None:
        self._fs.create(self._at("marks", batch), True).close()

    def put(self, kind: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def get(self, kind: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/batch={batch}")

    def newest(self, kind: str, before: int | None = None) -> DataFrame | None:
        """The last whole table of a kind that counts."""
        last = self.last()
        for n in reversed(self._batches(kind)):
            if n <= last and (before is None or n < before) and self._fs.exists(self._at(kind, f"batch={n}", "_SUCCESS")):
                return self.get(kind, n)
        return None

    def acks(self) -> DataFrame | None:
        """Every ack of the batches that count, with its ``batch``."""
        last = self.last()
        return None if last < 0 else self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/acks").where(F.col("batch") <= last)

    def finished(self) -> DataFrame | None:
        a = self.acks()
        return None if a is None else a.where("ok").drop("batch")

    def known(self) -> DataFrame | None:
        """(topic, part, off, ok) of every record that came: finished, or not yet."""
        acks, left = self.acks(), self.newest("open")
        return None if acks is None else newest(acks.select(*ID, "ok").union(left.select(*ID, F.lit(False).alias("ok"))))

    def commits(self) -> DataFrame | None:
        return self.newest("commits")

    def forget(self, before: int) -> None:
        """Drops states, commits and marks that newer ones replace, so that none of them grows with the stream."""
        old = [(kind, n) for kind in ("runs", "open") for n in self._batches(kind) if n < before]
        old += [("commits", n) for n in [n for n in self._batches("commits") if n < before][:-1]]
        for kind, n in old:
            self._fs.delete(self._at(kind, f"batch={n}"), True)
        for x in self._names("marks"):
            if int(x) < before:
                self._fs.delete(self._at("marks", x), False)


def newest(acks: DataFrame) -> DataFrame:
    """The last word on each record: whether any batch finished it."""
    return acks.groupBy(*ID).agg(F.max("ok").alias("ok"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """(topic, part, lo, hi): runs that touch or overlap as one."""
    by = Window.partitionBy(*PARTITION).orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("new", F.coalesce(F.col("lo") > reach + 1, F.lit(True)).cast("int"))
    return opened.withColumn("n", F.sum("new").over(by)).groupBy(*PARTITION, "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("n")


def outside_runs(records: DataFrame, runs: DataFrame, most: int = 200_000) -> DataFrame:
    """Records whose offset lies in no run: the run that began last before an offset decides.

    Up to ``most`` runs are broadcast, a sorted list for each partition, which is
    searched by halving.  More of them are found in one sort of both.
    """
    names = records.columns
    if runs.count() <= most:
        held = runs.groupBy(*PARTITION).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs_of_it"))
        steps = ", ".join(str(1 << i) for i in reversed(range(most.bit_length())))
        at = F.expr(f"aggregate(array({steps}), 0, (n, s) -> if(n + s <= size(runs_of_it) and runs_of_it[n + s - 1].lo <= off, n + s, n))")
        found = records.join(F.broadcast(held), PARTITION, "left").withColumn("run_of_it", at)
        return found.where("runs_of_it is null or run_of_it = 0 or runs_of_it[run_of_it - 1].hi < off").select(names)
    own = records.select(F.struct(*names).alias("r"), *PARTITION, F.col("off").alias("lo"), F.lit(None).cast("long").alias("hi"))
    both = own.unionByName(runs.select(F.lit(None).cast(own.schema["r"].dataType).alias("r"), *PARTITION, "lo", "hi"))
    last = F.last("hi", ignorenulls=True).over(Window.partitionBy(*PARTITION).orderBy("lo", F.col("hi").asc_nulls_last()))
    return both.withColumn("end", last).where("r is not null and (end is null or end < lo)").select("r.*")


def state_of(runs: DataFrame, left: DataFrame) -> DataFrame:
    """Partition state from finished runs and open records."""
    rows = runs.select(*PARTITION, F.col("hi").alias("off"), F.lit(True).alias("succeeded")).unionByName(left.select(*PARTITION, "off", F.lit(False).alias("succeeded")))
    return offsets.partition_state(rows)


class Stream:
    """A running stream: it can be paused and resumed, asked to commit, watched, and closed."""

    def __init__(self, begin: Callable, options: Options, ledger: Ledger):
        self._begin, self.options, self.ledger = begin, options, ledger
        self.hooks: list[Callable] = []
        self.finish: Callable = lambda: None
        self.asked = threading.Event()
        self.status, self.failure = Status.RUNNING, None
        self.background = ThreadPoolExecutor(1)
        self.pending = self.uncommitted = None
        self.last_commit = 0.0
        self.loops = 0
        self.query = begin()

    def __getattr__(self, name: str):
        return getattr(self.__dict__["query"], name)

    def add_loop_end_callback(self, f: Callable) -> None:
        """``f(stream, batch)`` runs at the end of each micro-batch."""
        self.hooks.append(f)

    def request_commit_asap(self) -> None:
        """The next micro-batch commits, whether the interval has passed or not."""
        self.asked.set()

    def pause_if_running(self) -> None:
        """Takes no more records; the batch that runs is finished, and the ledger and the checkpoint stay."""
        if self.status is Status.RUNNING:
            self.status = Status.PAUSED
            self._settle(self.options.shutdown_timeout)
            self.query.stop()

    def resume_if_paused(self) -> None:
        if self.status is Status.PAUSED:
            self.query, self.status = self._begin(), Status.RUNNING

    def _settle(self, timeout: float) -> None:
        end = time.monotonic() + timeout
        while self.query.isActive and self.query.status["isTriggerActive"] and time.monotonic() < end:
            time.sleep(0.02)

    def failure_cause(self) -> str | None:
        e = self.failure or self.query.exception()
        return str(e) if e is not None else None

    def is_closed_or_failed(self) -> bool:
        return self.status is Status.CLOSED or self.failure_cause() is not None

    def work_remaining(self) -> int:
        left = self.ledger.newest("open")
        return 0 if left is None else left.count()

    def paused_partitions(self) -> int:
        """Partitions that take no records above their highest succeeded offset; all of them while the stream is paused."""
        c = self.ledger.commits()
        return 0 if c is None else c.count() if self.status is Status.PAUSED else c.where("not allowed").count()

    def close(self, drain: bool = False, timeout: float | None = None) -> None:
        """``drain``: what is buffered is worked off first, for at most the drain timeout; else only the batch that runs is."""
        if self.status is Status.CLOSED:
            return
        self.status = Status.DRAINING if drain else Status.CLOSING
        end = time.monotonic() + (self.options.drain_timeout if timeout is None else timeout)
        quiet, last = 0, None
        while drain and quiet < 2 and self.query.isActive and time.monotonic() < end:
            # Two triggers without new records, and nothing open.
            p = self.query.lastProgress
            if p is not None and p["timestamp"] != last:
                last = p["timestamp"]
                new = sum(x["numInputRows"] for x in p["sources"] if not x["description"].startswith("Rate"))
                quiet = 0 if new or self.work_remaining() else quiet + 1
            time.sleep(0.02)
        self._settle(self.options.shutdown_timeout if timeout is None else timeout)
        self.query.stop()
        self.finish()
        self.background.shutdown(wait=True)
        self.status = Status.CLOSED


def retried(f: Callable, times: int, wait: float = 0.0, only: tuple = (Exception,)):
    """``f()``, tried again up to ``times`` times."""
    for n in range(times + 1):
        try:
            return f()
        except only:
            if n == times:
                raise
            time.sleep(wait)


def process(
    stream: DataFrame, fn: Callable, options: Options, ledger: Ledger, checkpoint: str, out: str | None = None, attempts: int = 3, drain: bool = True,
    epochs: Callable[[], DataFrame] | None = None, on_result: Callable | None = None, listener: Callable | None = None, metadata_limit: int = codec.METADATA_LIMIT,
) -> Stream:
    """Starts a query that runs ``fn`` over a stream of records and keeps the ledger.

    Each micro-batch takes its new records and those that earlier ones left behind,
    without records that are finished; a record that failed waits for its delay.
    A clock beside the stream lets batches begin without new records, so that what
    was left behind is tried again, and what is not yet committed is, in time.
    Records above the highest succeeded offset of a partition whose last commit was
    not ``allowed`` wait.  ``epochs()`` gives the current (topic, part, epoch) and
    fences records of others, which are dropped.  ``drain``: ends when all that is
    there has been read; else it runs on at the options' commit interval.

    Commits are due when the interval has passed or one was asked for, and are
    written for partitions whose payload changed: in the background in the
    asynchronous mode, before the batch counts in the others; with transactions at
    every batch.  ``on_result(row)`` gets each produced record after its batch
    counts; ``listener(kind, partitions)`` hears of partitions that come or go.
    """
    options.validate(sink=out is not None)
    names = stream.columns
    held: dict[str, Stream] = {}
    seen: set = set()
    started = threading.Event()
    mode = options.commit_mode

    def commit(batch: int, me: Stream) -> None:
        runs, left = ledger.get("runs", batch), ledger.get("open", batch)
        before = ledger.newest("commits", batch)
        rows = codec.payloads(state_of(runs, left), left, metadata_limit)
        if before is not None:
            dirty = offsets.dirty_commits(rows, before.withColumnRenamed("to_commit", "committed"))
            rows = dirty.unionByName(before.join(dirty, PARTITION, "left_anti"), allowMissingColumns=True)
        try:
            retried(lambda: ledger.put("commits", rows.select(*(c.split()[0] for c in COMMITS.split(", "))), batch), options.commit_retries, 0.1)
        except Exception as e:
            me.failure = e
            raise
        me.last_commit = time.monotonic()
        if me.uncommitted == batch:
            me.uncommitted = None

    def due(me: Stream) -> bool:
        asked = me.asked.is_set()
        me.asked.clear()
        return asked or time.monotonic() - me.last_commit >= options.interval

    def step(df: DataFrame, batch: int) -> None:
        started.wait()
        me = held["it"]
        work(df, batch, me)
        me.loops += 1
        for f in me.hooks:
            f(me, batch)

    def work(df: DataFrame, batch: int, me: Stream) -> None:
        if me.pending is not None:
            me.pending.result()  # a commit in the background ends before its state may go
            me.pending = None
        spark = df.sparkSession
        runs, left = ledger.newest("runs", batch), ledger.newest("open", batch)
        if not drain and df.isEmpty() and (left is None or left.isEmpty()):
            if me.uncommitted is not None and due(me):
                commit(me.uncommitted, me)
            return
        new = shards.dedup(df.select(names))
        for c, kind in zip(HISTORY, ("long", "long", "string")):
            new = new.withColumn(c, F.lit(0 if c == "attempts" else None).cast(kind))
        if runs is not None:
            todo = left.unionByName(outside_runs(new, runs).join(left, ID, "left_anti"))
        else:
            todo = new
        if epochs is not None:
            todo = reconcile.fence(todo, epochs())[0]
        if listener:
            now = {tuple(r) for r in df.select(*PARTITION).distinct().collect()}  # a row a partition
            if now - seen:
                listener("assigned", now - seen)
                seen.update(now)
        take, kept = todo, None
        commits = ledger.newest("commits", batch)
        if commits is not None:
            s = commits.where("not allowed").select(*PARTITION, "highest_succeeded")
            blocked = todo.join(s, PARTITION).where("off >= highest_succeeded").drop("highest_succeeded")
            kept = blocked.select(todo.columns)
            take = todo.join(blocked.select(*ID), ID, "left_anti")
        p = Processor(spark, options, take, attempts)
        acks = p.poll(fn) if out is None else p.poll_and_produce_many(fn, out)
        ledger.put("acks", acks, batch)  # the user's function has run once: what follows reads its acks
        acks = ledger.get("acks", batch)
        ok = acks.where("ok").select(*PARTITION, F.col("off").alias("lo"), F.col("off").alias("hi"))
        ledger.put("runs", merge_runs(ok if runs is None else runs.unionByName(ok)), batch)
        failed = acks.where("not ok").select(*names, *HISTORY)
        # Records behind a failing head were not tried; they stay open with what they had.
        rest = take.select(*names, *HISTORY).join(acks.select(*ID), ID, "left_anti")
        rest = failed.unionByName(rest)
        ledger.put("open", rest if kept is None else rest.unionByName(kept.select(*names, *HISTORY)), batch)
        me.uncommitted = batch
        if mode is CommitMode.TRANSACTION or drain or due(me):
            if mode is CommitMode.ASYNC and not drain:
                me.pending = me.background.submit(commit, batch, me)
            else:
                commit(batch, me)
        ledger.mark(batch)
        ledger.forget(batch - 1)
        if on_result and out is not None:
            for r in acks.where("ok").select(*ID, F.inline("made")).toLocalIterator():
                on_result(r)

    def begin():
        source = stream
        if not drain:
            clock = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
            source = stream.unionByName(clock.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields)))
        writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{options.interval} seconds")).start()

    held["it"] = me = Stream(begin, options, ledger)

    def finish() -> None:
        """What a stream that closes has not committed."""
        if me.pending is not None:
            me.pending.result()
        if me.uncommitted is not None:
            commit(me.uncommitted, me)

    me.finish = finish
    started.set()
    return me


def run_with_restarts(start: Callable[[], Stream], timeout: float = 0.0, wait: float = 5.0) -> Stream:
    """Starts a stream, again after ``wait`` seconds where its source refuses, until ``timeout`` seconds have gone."""
    end = time.monotonic() + timeout
    while True:
        try:
            return start()
        except Exception:
            if time.monotonic() + wait > end:
                raise
            time.sleep(wait)


def restore(records: DataFrame, commits: DataFrame, options: Options | None = None, first_polled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records that still have to run, incomplete offsets) after a cold start from ``commits`` (topic, part, committed, metadata).

    Payloads are decoded; a partition without a commit starts anew.  What the log no
    longer has is reconciled: a first offset above the committed one drops incompletes
    below it, one below it discards the partition's state, and incompletes within
    what was polled but not there were removed by compaction.
    """
    options = options or Options()
    state, todo = reconcile.load(commits, options.foreign_metadata)
    first = first_polled if first_polled is not None else records.groupBy(*PARTITION).agg(F.min("off").alias("first"))
    first = first.join(commits.select(*PARTITION, "committed"), PARTITION)
    rewound = first.where("first < committed").select(*PARTITION)
    state = state.join(rewound, PARTITION, "left_anti")
    todo = reconcile.compact(reconcile.truncate(todo, first), records)
    return offsets.replay(records, state.withColumnRenamed("highest_seen", "highest_succeeded"), todo), todo


def pause(stream: Stream) -> None:
    stream.pause_if_running()


def close(stream: Stream, drain: bool = False) -> None:
    stream.close(drain)

