"""A bounded run over a log: user functions, acks and outputs under an ordering."""

from __future__ import annotations

import asyncio
import heapq
import inspect
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..model import CommitMode, Options, Ordering, Status
from ..operators import offsets, reconcile, shards

#: What a record's work adds to it: attempts are failed ones; times are microseconds.
ACK = "ok boolean, attempts long, reason string, retriable boolean, failed_us long, succeeded_us long, took_us long"
#: Columns that a log may bring from earlier runs.
HISTORY = ("attempts", "failed_us", "reason")


class Retriable(Exception):
    """An expected failure.  It is retried as any other; its acks are told apart by ``retriable``."""


@dataclass
class Batch:
    """What a user function gets: records (as dictionaries) with their failed attempts so far, and when and why the last one failed."""

    records: list[dict]
    attempts: int = 0
    failed_us: int | None = None
    reason: str | None = None

    def __len__(self) -> int:
        return len(self.records)

    def __iter__(self) -> Iterator[dict]:
        return iter(self.records)

    def single(self) -> dict:
        if len(self.records) != 1:
            raise ValueError(f"a batch of {len(self.records)} records has no single one")
        return self.records[0]

    @property
    def value(self):
        return self.single()["value"]

    @property
    def key(self):
        return self.single()["k"]

    @property
    def offset(self) -> int:
        return self.single()["off"]

    def ids(self) -> list[tuple[str, int, int]]:
        return [(r["topic"], r["part"], r["off"]) for r in self.records]

    def flat_offsets(self) -> list[int]:
        return [r["off"] for r in self.records]

    def offsets(self) -> dict[tuple[str, int], list[int]]:
        out: dict[tuple[str, int], list[int]] = {}
        for r in self.records:
            out.setdefault((r["topic"], r["part"]), []).append(r["off"])
        return out

    def by_partition(self) -> dict[tuple[str, int], list[dict]]:
        out: dict[tuple[str, int], list[dict]] = {}
        for r in self.records:
            out.setdefault((r["topic"], r["part"]), []).append(r)
        return out


@dataclass
class Request:
    """Where an HTTP form of a user function wants to go."""

    host: str
    path: str = "/"
    port: int = 8080
    params: dict[str, str] = field(default_factory=dict)


class Results:
    """Results as they come, for one reader: a stream takes what is there and ends when nothing is left, without waiting."""

    def __init__(self):
        self._held: deque = deque()

    def push(self, result) -> None:
        self._held.append(result)

    def stream(self) -> Iterator:
        while self._held:
            yield self._held.popleft()


def now_us() -> int:
    return time.time_ns() // 1000


class Scheduler:
    """Runs batches of shards within a task: one of each ordered shard at a time, up to ``limit`` in all.

    ``start`` begins a batch and returns a future.  A failed batch is tried again
    once its delay has passed, without holding a place meanwhile; after ``tries``
    failures it stays incomplete, and its shard is closed.  ``here`` calls a batch
    in the task itself: with a limit of one it takes the place of ``start``, as
    nothing else could run meanwhile, and spares each batch two changes of threads.
    """

    def __init__(self, start: Callable[[Batch], Future], limit: int, tries: int, size: int, delay: Callable[[Batch], float], buffer: int, ordered: bool, here: Callable[[Batch], list] | None = None):
        self.start, self.limit, self.tries, self.size, self.delay, self.buffer, self.ordered = start, limit, tries, size, delay, buffer, ordered
        self.waiting: dict = {}  # shard: its records that wait
        self.ready: deque = deque()  # shards, or batches of the unordered, that may begin
        self.later: list = []  # (due, number, shard, batch)
        self.running: dict[Future, tuple] = {}
        self.closed: set = set()
        self.held = self.number = 0
        self.most = 0
        self.here = here if limit == 1 else None

    def add(self, shard, record: dict) -> None:
        if shard in self.closed:
            return
        self.held += 1
        queue = self.waiting.get(shard)
        if queue is None:
            queue = self.waiting[shard] = deque()
            self.ready.append((shard, None))
        queue.append(record)

    def _next(self) -> tuple | None:
        while self.ready:
            shard, batch = self.ready.popleft()
            if batch is None:
                queue = self.waiting.get(shard)
                if not queue:
                    self.waiting.pop(shard, None)
                    continue
                records = [queue.popleft() for _ in range(min(self.size, len(queue)))]
                first = records[0]
                batch = Batch(records, max(r.get("attempts") or 0 for r in records), first.get("failed_us"), first.get("reason"))
                if not self.ordered:
                    self.ready.appendleft((shard, None))
                rest = batch.failed_us / 1e6 + self.delay(batch) - time.time() if batch.failed_us else 0
                if rest > 0:  # it failed in an earlier run
                    self.number += 1
                    heapq.heappush(self.later, (time.monotonic() + rest, self.number, shard, batch))
                    continue
            return shard, batch
        return None

    def advance(self, block: bool) -> Iterator[tuple[Batch, bool, list, BaseException | None, int]]:
        """Begins what may begin, and gives what has ended; ``block``: waits until something has."""
        now = time.monotonic()
        while self.later and self.later[0][0] <= now:
            _, _, shard, batch = heapq.heappop(self.later)
            self.ready.append((shard, batch))
        if self.here:
            if due := self._next():
                shard, batch = due
                self.most, began = 1, now_us()
                try:
                    made, error = self.here(batch), None
                except BaseException as e:  # noqa: BLE001  every failure is retried, as those of threads
                    made, error = [], e
                yield from self._ended(shard, batch, made, error, now_us() - began)
            elif block and self.later:
                time.sleep(max(0.0, self.later[0][0] - time.monotonic()))
            return
        while len(self.running) < self.limit and (due := self._next()):
            shard, batch = due
            self.running[self.start(batch)] = (shard, batch, now_us())
        self.most = max(self.most, len(self.running))
        if not self.running:
            if block and self.later:
                time.sleep(max(0.0, self.later[0][0] - time.monotonic()))
            return
        rest = max(0.0, self.later[0][0] - time.monotonic()) if self.later else None
        done, _ = wait(self.running, timeout=rest if block else 0, return_when=FIRST_COMPLETED)
        for f in done:
            shard, batch, began = self.running.pop(f)
            error = f.exception()
            yield from self._ended(shard, batch, f.result() if error is None else [], error, now_us() - began)

    def _ended(self, shard, batch: Batch, made: list, error: BaseException | None, took: int) -> Iterator[tuple[Batch, bool, list, BaseException | None, int]]:
        if error is None:
            yield batch, True, made, None, took
        else:
            batch.attempts, batch.failed_us, batch.reason = batch.attempts + 1, now_us(), f"{type(error).__name__}: {error}"
            tried = batch.tried = getattr(batch, "tried", 0) + 1
            if tried < self.tries:
                self.number += 1
                heapq.heappush(self.later, (time.monotonic() + self.delay(batch), self.number, shard, batch))
                return
            yield batch, False, [], error, took
        self.held -= len(batch)
        if self.ordered:
            if error is None:
                self.ready.append((shard, None))
            else:
                self.closed.add(shard)
                self.held -= len(self.waiting.pop(shard, ()))

    @property
    def idle(self) -> bool:
        return not (self.running or self.later or self.ready)


@dataclass
class Processor:
    """Runs a user function over every record of a log that has not been completed.

    ``log`` has topic, part, off, k and value, and may bring the HISTORY of earlier
    runs.  A call plans the work; it runs when the returned frame does.  A function
    that raises is called again, when its delay has passed, up to ``attempts`` times
    within the run; records that still fail stay incomplete, and in an ordered shard
    those behind them wait for the next run.

    Shards are dealt over tasks by hash, records of a task come in the order of the
    log, and up to ``max_concurrency`` batches are in flight in all tasks together:
    each task has its share, in threads, or in one event loop for coroutines.  With
    ``epochs`` (topic, part, epoch), records of another epoch are not run.
    """

    spark: SparkSession
    options: Options = field(default_factory=Options)
    log: DataFrame | None = None
    attempts: int = 3
    epochs: DataFrame | None = None
    status: Status = Status.UNUSED

    def source(self, log: DataFrame) -> Processor:
        self.log = log
        return self

    def stale(self) -> DataFrame:
        """The records of the log that a run leaves alone because their epoch has passed."""
        return reconcile.fence(self.log, self.epochs)[1] if self.epochs is not None else self.log.limit(0)

    def _begin(self, produces: bool = False, asynchronous: bool = False) -> None:
        if self.status is not Status.UNUSED:
            raise RuntimeError("a processor is used once")
        if self.log is None:
            raise ValueError("a source is needed")
        if asynchronous and self.options.commit_mode is CommitMode.TRANSACTION:
            raise ValueError("asynchronous functions cannot be in a transaction")
        self.options.validate(sink=produces)
        self.status = Status.RUNNING

    def tasks(self) -> tuple[int, int]:
        """Tasks of a run and batches in flight in each."""
        n = max(1, min(self.options.max_concurrency, self.spark.sparkContext.defaultParallelism))
        return n, self.options.max_concurrency // n

    def _run(self, call: Callable[[Batch], object], out: str | None, asynchronous: bool = False) -> DataFrame:
        ordering, options, tries = self.options.ordering, self.options, self.attempts
        ordered = ordering is not Ordering.UNORDERED
        log = self.log if self.epochs is None else reconcile.fence(self.log, self.epochs)[0]
        names = log.columns
        history = [c for c in HISTORY if c in names]
        own = [c for c in names if c not in history]
        n, limit = self.tasks()
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in log.select(own).schema.fields]
        schema = StructType.fromDDL(", ".join([*kinds, ACK]) + (f", made array<struct<{out}>>" if out else ""))
        fields = [f.name for f in StructType.fromDDL(out).fields] if out else []
        columns = ordering.columns
        arrow = to_arrow_schema(schema)
        buffer = max(options.buffer_size, options.load_factor() * options.target, limit * options.batch_size * 2)

        def partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool, loop, here = None, None, None
            if asynchronous:
                loop = asyncio.new_event_loop()
                thread = threading.Thread(target=loop.run_forever, daemon=True)
                thread.start()

                async def wrapped(b: Batch):
                    return await _complete(call(b))

                start = lambda b: asyncio.run_coroutine_threadsafe(wrapped(b), loop)
            else:
                pool = ThreadPoolExecutor(limit)
                start = lambda b: pool.submit(call, b)
                here = (lambda b: _rows(call(b), fields)) if out else call
            if out:
                begin = start
                start = lambda b: _then(begin(b), lambda made: _rows(made, fields))
            s = Scheduler(start, limit, tries, options.batch_size, options.delay_of, buffer, ordered, here)
            some: list[dict] = []

            def ended(block: bool) -> None:
                for b, ok, made, error, took in s.advance(block):
                    done_us = now_us()
                    for j, r in enumerate(b.records):
                        row = {c: r[c] for c in own}
                        row |= {"ok": ok, "attempts": b.attempts, "reason": b.reason, "retriable": isinstance(error, Retriable), "failed_us": b.failed_us, "succeeded_us": done_us if ok else None, "took_us": took}
                        if out:
                            row["made"] = made if ok and j == 0 else []
                        some.append(row)

            def full() -> Iterator[pa.RecordBatch]:
                while len(some) >= 1024:
                    yield pa.RecordBatch.from_pylist(some[:1024], schema=arrow)
                    del some[:1024]

            before = None
            try:
                for frame in batches:
                    for r in frame.to_pylist():
                        if (own_id := tuple(r[c] for c in shards.ID)) == before:
                            continue  # a record that comes again: it is in the same task, next to itself
                        before = own_id
                        s.add(tuple(r[c] for c in columns) if ordered else (), r)
                        if s.held >= limit * options.batch_size and len(s.running) < limit:
                            ended(False)
                        while s.held >= buffer:
                            ended(True)
                        yield from full()
                while not s.idle:
                    ended(True)
                    yield from full()
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=arrow)
            finally:
                if pool:
                    pool.shutdown(wait=False, cancel_futures=True)
                if loop:
                    loop.call_soon_threadsafe(loop.stop)

        # A number that is asked for: small rows must not bring slow calls together in one task.
        if ordering is Ordering.PARTITION:
            log = deal(log, n).select(names)
        else:
            log = log.repartition(n, *columns) if ordered else log.repartition(n, F.xxhash64(*shards.ID))
        return log.sortWithinPartitions("topic", "off", "part").mapInArrow(partition, schema)

    def poll(self, fn: Callable[[Batch], object]) -> DataFrame:
        """Acks: each record that was tried, with ok, failed attempts, and the reason and time of the last failure.  What ``fn`` returns is ignored."""
        self._begin()

        def call(b: Batch) -> None:
            fn(b)

        return self._run(call, None)

    def poll_and_produce_many(self, fn: Callable[[Batch], Iterable[tuple]], out: str, on_result: Callable | None = None, sink: Callable | None = None) -> DataFrame:
        """Acks with ``made``: the records that each batch's function returned, none or many; ``out`` names their columns as in a struct.

        ``sink(record)`` sends a record and returns a future of its metadata: all records
        of a batch are sent first, then awaited within the send timeout, and a failure
        fails the batch.  ``on_result(batch, record, metadata)`` is called once for each
        record, in the task that made it.
        """
        self._begin(produces=True)
        timeout = self.options.send_timeout

        def call(b: Batch) -> list:
            made = fn(b)
            made = [] if made is None else list(made)
            sent = [sink(m) for m in made] if sink else [None] * len(made)
            told = [f.result(timeout) if f is not None else None for f in sent]
            for m, meta in zip(made, told) if on_result else ():
                on_result(b, m, meta)
            return made

        return self._run(call, out)

    def poll_and_produce(self, fn: Callable[[Batch], tuple], out: str, on_result: Callable | None = None, sink: Callable | None = None) -> DataFrame:
        return self.poll_and_produce_many(lambda b: [fn(b)], out, on_result, sink)

    def results(self, acks: DataFrame) -> Iterator:
        """What was produced, row by row, as partitions come to the driver."""
        return produced(acks).toLocalIterator()

    def poll_async(self, fn: Callable, out: str | None = None) -> DataFrame:
        """The same for a function that returns an awaitable, an asynchronous iterator, or nothing to wait for; acks come when it completes."""
        self._begin(produces=out is not None, asynchronous=True)
        return self._run(fn, out, asynchronous=True)

    #: The same under the names of reactive forms: a publisher completes with its last item, a single value may be none.
    react = on_record = poll_async

    def poll_requests(self, request: Callable[[Batch], Request], client: Callable, out: str | None = None, on_send: Callable | None = None, on_complete: Callable | None = None) -> DataFrame:
        """``client(Request)`` returns an awaitable response for what ``request`` makes of a batch; hooks get the batch, and the response when it is there.

        With ``out`` the response is the batch's result, a tuple or several.
        """

        async def call(b: Batch):
            going = client(request(b))
            if on_send:
                on_send(b)
            response = await _complete(going)
            if on_complete:
                on_complete(b, response)
            return response

        return self.poll_async(call, out)

    def close(self) -> None:
        self.status = Status.CLOSED


def deal(log: DataFrame, n: int) -> DataFrame:
    """The log in ``n`` tasks, each with as many of its topics' partitions as any other, give or take one; largest first, so that the rest is small.

    A hash brings several of a few partitions together in one task, and each of them
    is serial.  ``dealt`` is the task; a row a partition is counted and broadcast.
    """
    sizes = log.groupBy(*offsets.PARTITION).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), *offsets.PARTITION)) - 1
    tasks = sizes.select(*offsets.PARTITION, F.pmod(place, F.lit(n)).cast("int").alias("dealt"))
    by_hash = F.pmod(F.hash(*offsets.PARTITION), F.lit(n)).cast("int")
    dealt = log.join(F.broadcast(tasks), offsets.PARTITION, "left").withColumn("dealt", F.coalesce("dealt", by_hash))
    return dealt.repartitionById(n, "dealt")


async def _complete(x):
    if inspect.isawaitable(x):
        x = await x
    if hasattr(x, "__aiter__"):
        x = [item async for item in x]
    return x


def _then(f: Future, g: Callable) -> Future:
    out: Future = Future()

    def done(f: Future) -> None:
        try:
            out.set_result(g(f.result()))
        except BaseException as e:  # noqa: BLE001  every failure is retried
            out.set_exception(e)

    f.add_done_callback(done)
    return out


def _rows(made, fields: list[str]) -> list[dict]:
    if made is None:
        return []
    if isinstance(made, tuple):
        made = [made]
    return [dict(zip(fields, m if isinstance(m, tuple) else (m,), strict=True)) for m in made]


def produced(acks: DataFrame) -> DataFrame:
    """(in: topic, part, off; and the columns of each produced record)."""
    return acks.where("ok").select("topic", "part", "off", F.inline("made"))


def progress(log: DataFrame, acks: DataFrame) -> DataFrame:
    """The state of each partition after a run."""
    done = acks.where("ok").select(*shards.ID).distinct().withColumn("succeeded", F.lit(True))
    work = shards.dedup(log).join(done, shards.ID, "left").withColumn("succeeded", F.coalesce("succeeded", F.lit(False)))
    return offsets.partition_state(work)


def work_remaining(state: DataFrame) -> int:
    return int(state.agg(F.coalesce(F.sum("incompletes"), F.lit(0))).first()[0])
