"""Runs with user functions, bounded and streaming."""

import time
from concurrent.futures import Future

import pytest
from pyspark.sql import functions as F

from sparrowlog.functions import codec
from sparrowlog.model import CommitMode, Options, Ordering, Status
from sparrowlog.operators import metrics, offsets
from sparrowlog.plans.runner import Batch, Processor, Request, Results, Retriable, Scheduler, deal, produced, progress, work_remaining
from sparrowlog.sources.log import broker, files, per_trigger
from sparrowlog.streaming.ledger import Ledger, close, merge_runs, outside_runs, process, restore, retried, run_with_restarts

SCHEMA = "topic string, part int, off long, k string, value long"


def log(spark, n=40):
    return spark.createDataFrame([("t", i % 3, i // 3, f"k{i % 5}", i) for i in range(n)], SCHEMA)


def test_acks_order_and_progress(spark):
    def fn(b):
        if b.value == 10:
            raise ValueError("never")
        if b.value % 7 == 0 and b.attempts < 1:
            raise ValueError("once")

    df = log(spark)
    acks = Processor(spark, Options(retry_delay=0.01), df).poll(fn)
    rows = {r.value: r for r in acks.collect()}
    assert not rows[10].ok and rows[10].reason == "ValueError: never" and rows[10].attempts == 3
    assert rows[7].ok and rows[7].attempts == 1
    assert 25 not in rows and 11 in rows  # behind the failing head of its shard; and in another
    s = {r.part: r for r in progress(df, acks).collect()}
    assert s[1].to_commit == 3 and s[0].to_commit == 14 and work_remaining(progress(df, acks)) == 2


@pytest.mark.parametrize("ordering", list(Ordering))
def test_produce_many_and_batches(spark, ordering):
    def fn(b):
        return [(r["value"], len(b)) for r in b for _ in range(r["value"] % 3)]

    out = produced(Processor(spark, Options(ordering=ordering, batch_size=2), log(spark)).poll_and_produce_many(fn, "v:bigint, n:int")).collect()
    assert sorted(r.v for r in out) == sorted(i for i in range(40) for _ in range(i % 3))
    assert max(r.n for r in out) == 2


def test_a_batch_fails_as_a_whole(spark):
    def fn(b):
        if any(r["value"] == 6 for r in b):
            raise ValueError("no")

    acks = Processor(spark, Options(ordering=Ordering.UNORDERED, batch_size=4, retry_delay=0), log(spark, 12)).poll(fn).collect()
    failed = {r.value for r in acks if not r.ok}
    assert len(acks) == 12 and 6 in failed and len(failed) <= 4


def test_async_waits_together(spark):
    async def fn(b):
        import asyncio

        await asyncio.sleep(0.05)
        if b.value == 3:
            raise ValueError("no")
        return [(b.value,)]

    df = log(spark, 64).coalesce(1)
    acks = Processor(spark, Options(ordering=Ordering.UNORDERED, max_concurrency=32), df, attempts=1).poll_async(fn, "v:bigint").collect()
    assert sorted(m.v for r in acks for m in r.made) == [i for i in range(64) if i != 3]
    with pytest.raises(ValueError):
        Processor(spark, Options(commit_mode=CommitMode.TRANSACTION), df).poll_async(fn)


def test_single_use_and_accessors(spark):
    p = Processor(spark, Options(), log(spark, 2))
    p.poll(len)
    with pytest.raises(RuntimeError):
        p.poll(len)
    with pytest.raises(ValueError):
        Processor(spark).poll(len)
    b = Batch([{"topic": "t", "part": 0, "off": 1, "k": "a", "value": 2}, {"topic": "t", "part": 0, "off": 2, "k": "a", "value": 3}])
    assert b.offsets() == {("t", 0): [1, 2]} and len(b.by_partition()["t", 0]) == 2
    with pytest.raises(ValueError):
        _ = b.value


def test_stream_keeps_a_ledger(spark, tmp_path):
    path, marker = str(tmp_path / "log"), str(tmp_path / "fixed")
    log(spark).write.parquet(path)

    def fn(b):
        import os

        if b.value == 10 and not os.path.exists(marker):
            raise ValueError("later")
        return [(b.value,)]

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    run = lambda: process(files(spark, path, SCHEMA, stream=True), fn, Options(retry_delay=0), ledger, str(tmp_path / "checkpoint"), "v:bigint").query.awaitTermination()
    run()
    assert ledger.known().where("not ok").count() == 2
    (first,) = [r for r in ledger.commits().collect() if r.part == 1]
    assert codec.decode(first.to_commit, first.metadata) == (first.highest_succeeded, [3, 8]) and first.to_commit == 3
    open(marker, "w").close()
    spark.createDataFrame([("t", 0, 100, "new", 100), ("t", 0, 5, "again", 5)], SCHEMA).write.mode("append").parquet(path)
    run()
    assert ledger.known().where("not ok").count() == 0
    done = ledger.finished()
    assert done.count() == 41 and done.select("topic", "part", "off").distinct().count() == 41
    assert {r.part: r.to_commit for r in ledger.commits().collect()} == {0: 101, 1: 13, 2: 13} and {r.metadata for r in ledger.commits().collect()} == {None}
    ledger.put("acks", spark.createDataFrame(ledger.get("acks", 1).collect(), ledger.get("acks", 1).schema), 1)
    assert ledger.finished().count() == 41  # a batch that is delivered again changes nothing
    assert [(r.part, r.lo, r.hi) for r in ledger.newest("runs").orderBy("part", "lo").collect()] == [(0, 0, 13), (0, 100, 100), (1, 0, 12), (2, 0, 12)]


def test_stream_is_paused_resumed_and_closed(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark).repartition(4).write.parquet(path)
    seen, heard, results = [], [], []
    options = Options(commit_interval=0.1, commit_mode=CommitMode.SYNC)
    s = process(files(spark, path, SCHEMA, stream=True, files_per_trigger=1), lambda b: [(b.value,)], options, Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "checkpoint"), "v:bigint", drain=False, on_result=results.append, listener=lambda kind, parts: heard.append((kind, len(parts))))
    s.add_loop_end_callback(lambda stream, batch: seen.append(batch))
    s.request_commit_asap()
    s.processAllAvailable()
    s.pause_if_running()
    assert not s.isActive and s.status is Status.PAUSED and s.paused_partitions() == 3
    log(spark, 43).where("value >= 40").write.mode("append").parquet(path)
    s.resume_if_paused()
    close(s, drain=True)
    assert s.status is Status.CLOSED and s.is_closed_or_failed() and s.failure_cause() is None and s.work_remaining() == 0
    assert seen == list(range(len(seen))) and sum(n for _, n in heard) == 3 and {r.v for r in results} == set(range(43))
    assert {r.part: r.to_commit for r in s.ledger.commits().collect()} == {0: 15, 1: 14, 2: 14}


def test_left_records_are_tried_without_new_ones(spark, tmp_path):
    path, marker = str(tmp_path / "log"), str(tmp_path / "fixed")
    log(spark, 9).write.parquet(path)

    def fn(b):
        import os

        if b.value == 4 and not os.path.exists(marker):
            raise ValueError("later")

    s = process(files(spark, path, SCHEMA, stream=True), fn, Options(commit_interval=0.3, retry_delay=0.1), Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "checkpoint"), attempts=1, drain=False)
    end = time.time() + 60
    while s.loops < 1 and time.time() < end:
        time.sleep(0.1)
    assert s.work_remaining() == 1
    open(marker, "w").close()
    s.close(drain=True, timeout=60)
    assert s.work_remaining() == 0 and s.failure_cause() is None and {r.part: r.to_commit for r in s.ledger.commits().collect()} == {0: 3, 1: 3, 2: 3}


def test_payload_pressure_holds_new_records(spark, tmp_path):
    """Until a partition's payload is short enough, only records below its highest succeeded offset are taken."""
    path, marker = str(tmp_path / "log"), str(tmp_path / "fixed")
    make = lambda a, b: spark.createDataFrame([("t", 0, i, f"k{i}", i) for i in range(a, b)], SCHEMA)
    make(0, 60).write.parquet(path)

    def fn(b):
        import os

        if b.value % 2 == 0 and b.value < 50 and not os.path.exists(marker):
            raise ValueError("no")

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    run = lambda: process(files(spark, path, SCHEMA, stream=True), fn, Options(retry_delay=0), ledger, str(tmp_path / "checkpoint"), attempts=1, metadata_limit=20).query.awaitTermination()
    run()
    (c,) = ledger.commits().collect()
    assert c.chars == 16 and not c.allowed and c.metadata is not None  # 2 + 8 + 1 bytes and the magic one
    open(marker, "w").close()
    make(60, 70).write.mode("append").parquet(path)
    run()
    assert {r.off for r in ledger.newest("open").collect()} == set(range(60, 70))
    make(70, 71).write.mode("append").parquet(path)
    run()
    assert ledger.known().where("not ok").count() == 0 and ledger.commits().first().to_commit == 71


def test_epochs_fence_a_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark).selectExpr("*", "cast(off % 2 as long) as epoch").write.parquet(path)
    now = spark.createDataFrame([("t", p, 1) for p in (0, 1)], "topic string, part int, epoch long")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    process(files(spark, path, SCHEMA + ", epoch long", stream=True), len, Options(commit_mode=CommitMode.TRANSACTION), ledger, str(tmp_path / "checkpoint"), epochs=lambda: now).query.awaitTermination()
    assert {(r.part, r.off % 2) for r in ledger.known().collect()} == {(0, 1), (1, 1)}
    p = Processor(spark, Options(), spark.read.parquet(path), epochs=now)
    assert p.poll(len).count() == ledger.known().count() and p.stale().count() == 40 - ledger.known().count()


def test_a_record_that_comes_again_runs_once(spark):
    for ordering in Ordering:
        out = Processor(spark, Options(ordering=ordering), log(spark).union(log(spark)).union(log(spark, 7))).poll(len).collect()
        assert len(out) == 40 and len({(r.topic, r.part, r.off) for r in out}) == 40


def test_runs(spark):
    r = spark.createDataFrame([("t", 0, 1, 3), ("t", 0, 4, 4), ("t", 0, 9, 9), ("t", 0, 2, 2), ("t", 1, 0, 0)], "topic string, part int, lo long, hi long")
    merged = merge_runs(r)
    assert sorted((x.part, x.lo, x.hi) for x in merged.collect()) == [(0, 1, 4), (0, 9, 9), (1, 0, 0)]
    rows = spark.createDataFrame([("t", p, o, "v") for p in (0, 1, 2) for o in range(11)], "topic string, part int, off long, v string")
    for most in (200_000, 0):
        assert sorted((x.part, x.off) for x in outside_runs(rows, merged, most).collect()) == [(0, o) for o in (0, 5, 6, 7, 8, 10)] + [(1, o) for o in range(1, 11)] + [(2, o) for o in range(11)]


def test_restore_reconciles_the_log(spark):
    todo = [11, 15, 20, 60, 80, 95, 96, 97, 98, 100]
    commits = spark.createDataFrame([("t", p, 11, codec.encode(11, 101, todo)) for p in range(3)] + [("t", 3, 5, "not base64!"), ("t", 4, 7, None)], "topic string, part int, committed long, metadata string")
    rows = [(0, o) for o in range(11, 103) if o not in (80, 95, 97)] + [(1, o) for o in range(20, 103)] + [(2, o) for o in range(6, 103)] + [(3, o) for o in range(5, 8)] + [(4, o) for o in range(7, 9)]
    records = spark.createDataFrame([("t", p, o) for p, o in rows], "topic string, part int, off long")
    left, _ = restore(records, commits)
    got = {}
    for r in left.collect():
        got.setdefault(r.part, []).append(r.off)
    assert sorted(got[0]) == [11, 15, 20, 60, 96, 98, 100, 102]  # compacted offsets are gone
    assert sorted(got[1]) == [o for o in todo if o >= 20] + [102]  # truncated
    assert sorted(got[2]) == list(range(6, 103))  # rewound: all runs again
    assert sorted(got[3]) == [5, 6, 7] and sorted(got[4]) == [7, 8]
    foreign = spark.createDataFrame([("t", 0, 7, "AgA=")], "topic string, part int, committed long, metadata string")
    with pytest.raises(Exception, match="another kind"):
        restore(records, foreign)[0].collect()


def test_acks_during_a_commit_stay_dirty(spark):
    work = lambda done: spark.createDataFrame([("t", 0, o, o in done) for o in range(6)], "topic string, part int, off long, succeeded boolean")
    paid = lambda done: codec.payloads(offsets.partition_state(work(done)), offsets.incompletes(work(done)))
    collected = paid({1}).withColumnRenamed("to_commit", "committed")
    assert offsets.dirty_commits(paid({1}), collected).count() == 0
    (now,) = offsets.dirty_commits(paid({1, 3}), collected).collect()  # the offset has not moved, the payload has
    assert now.to_commit == 0 and codec.decode(0, now.metadata) == (3, [0, 2])


def test_acks_behind_a_stripped_payload_are_dirty(spark):
    work = lambda done: spark.createDataFrame([("t", 0, o, o in done) for o in range(60)], "topic string, part int, off long, succeeded boolean")
    paid = lambda done: codec.payloads(offsets.partition_state(work(done)), offsets.incompletes(work(done)), limit=8)
    collected = paid({1, 50}).withColumnRenamed("to_commit", "committed")
    assert collected.first().metadata is None and offsets.dirty_commits(paid({1, 50}), collected).count() == 0
    (now,) = offsets.dirty_commits(paid({1, 3, 50}), collected).collect()
    assert now.metadata is None and codec.decode(0, now.payload) == (50, [o for o in range(50) if o not in (1, 3)])


def test_one_at_a_time_needs_no_thread():
    """With a limit of one, batches run in the task: in order, with retries, and a shard that fails is closed."""
    ran = []

    def here(b):
        ran.append((b.offset, b.attempts))
        if b.offset == 1 and b.attempts < 1 or b.offset == 3:
            raise SystemExit("no")
        return [b.offset]

    s = Scheduler(None, 1, 2, 1, lambda b: 0.01, 10, True, here)
    for o in range(6):
        s.add("a" if o < 5 else "b", {"off": o})
    out = []
    while not s.idle:
        out += [(b.offset, ok, made) for b, ok, made, _, _ in s.advance(True)]
    assert [x for x in out if x[0] != 5] == [(0, True, [0]), (1, True, [1]), (2, True, [2]), (3, False, [])] and (5, True, [5]) in out
    assert [x for x in ran if x[0] != 5] == [(0, 0), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1)] and s.held == 0 and s.most == 1


def test_partitions_are_dealt_evenly(spark):
    """12 partitions of two topics in 4, 6 and 12 tasks, numbered with any stride."""
    for stride in (1, 12):
        rows = spark.createDataFrame([(t, p * stride, o, "k", o) for t in "ab" for p in range(6) for o in range(3)], SCHEMA)
        for n in (4, 6, 12):
            got = deal(rows, n).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("topic", "part").alias("parts"), F.count("*").alias("rows")).collect()
            assert [(r.parts, r.rows) for r in got] == [(12 // n, 36 // n)] * n


def test_concurrency(spark):
    """Up to the limit run together, never more; a shard's records one after another."""
    rows = spark.createDataFrame([("t", 0, i, f"k{i % 40}", i) for i in range(400)], SCHEMA)

    def timed(fn, **options):
        began = time.time()
        out = Processor(spark, Options(max_concurrency=64, **options), rows).poll(fn).collect()
        return time.time() - began, out

    timed(len)
    took, out = timed(lambda b: time.sleep(0.02))
    assert len(out) == 400 and all(r.ok and r.took_us >= 20_000 for r in out)
    assert took < 4  # one after another they would take 8 seconds
    ends = {}
    for r in sorted(out, key=lambda r: r.off):
        assert r.succeeded_us >= ends.get(r.k, 0)
        ends[r.k] = r.succeeded_us

    async def slow(b):
        import asyncio

        await asyncio.sleep(0.02)

    began = time.time()
    assert Processor(spark, Options(max_concurrency=64), rows).poll_async(slow).count() == 400 and time.time() - began < 4


def test_retries_wait_without_holding_a_place(spark):
    rows = spark.createDataFrame([("t", 0, i, f"k{i}", i) for i in range(30)], SCHEMA)

    def fn(b):
        if b.attempts < 2:
            raise Retriable(f"attempt {b.attempts}")
        if not (b.reason == "Retriable: attempt 1" and b.failed_us and time.time() - b.failed_us / 1e6 >= 0.2):
            raise AssertionError("too early, or without its history")

    out = Processor(spark, Options(max_concurrency=2, retry_delay_of=lambda b: 0.2 * b.attempts), rows, attempts=3).poll(fn)
    began = time.time()
    got = out.collect()
    assert all(r.ok and r.attempts == 2 for r in got) and time.time() - began < 6  # in turn: 30 times 0.6 s in two places
    never = Processor(spark, Options(retry_delay=0), rows, attempts=2).poll(lambda b: (_ for _ in ()).throw(Retriable("no"))).collect()
    assert all(not r.ok and r.retriable and r.attempts == 2 and r.failed_us for r in never)


def test_any_result_will_do(spark):
    df = log(spark, 6).selectExpr("topic", "part", "off", "k", "1152921504606846977 + value as value")
    for answer in (0, False, "", 7, None, [1]):
        assert all(r.ok and r.value > 2**60 for r in Processor(spark, Options(), df).poll(lambda b, a=answer: a).collect())

        async def fn(b, a=answer):
            return a

        assert all(r.ok for r in Processor(spark, Options(), df).poll_async(fn).collect())
    assert all(r.ok and r.made == [] for r in Processor(spark, Options(), df).poll_and_produce_many(lambda b: None, "v:int").collect())
    bad = Processor(spark, Options(retry_delay=0), df).poll_and_produce_many(lambda b: 5, "v:int").collect()
    assert bad and not any(r.ok for r in bad)


def test_publishers_and_requests(spark):
    df = log(spark, 12)

    async def several(b):
        for i in range(b.value % 3):
            yield (b.value, i)

    out = produced(Processor(spark, Options(), df).react(several, "v:bigint, i:int")).collect()
    assert sorted((r.v, r.i) for r in out) == [(v, i) for v in range(12) for i in range(v % 3)]

    async def client(request):
        return (request.host, request.port, request.params["v"])

    p = Processor(spark, Options(), df)
    rows = list(p.results(p.poll_requests(lambda b: Request("host", params={"v": str(b.value)}), client, "h:string, p:int, v:string", on_send=lambda b: None, on_complete=lambda b, r: None)))
    assert sorted(int(r.v) for r in rows) == list(range(12)) and {(r.h, r.p) for r in rows} == {("host", 8080)}


def test_sinks_and_callbacks(spark, tmp_path):
    told = str(tmp_path / "told")

    def sink(record):
        f = Future()
        if record[0] == 5:
            f.set_exception(OSError("refused"))
        else:
            f.set_result(f"at {record[0]}")
        return f

    def on_result(b, record, meta):
        with open(told, "a") as f:
            f.write(f"{b.offset} {record[0]} {meta}\n")

    acks = Processor(spark, Options(retry_delay=0), log(spark, 8)).poll_and_produce(lambda b: (b.value,), "v:bigint", on_result=on_result, sink=sink).collect()
    assert {r.value: r.ok for r in acks}[5] is False and sorted(m.v for r in acks for m in r.made) == [0, 1, 2, 3, 4, 6, 7]
    assert sorted(line.split()[1] for line in open(told)) == list("0123467") and "2 7 at 7" in open(told).read()
    r = Results()
    r.push(1)
    r.push(2)
    assert list(r.stream()) == [1, 2] and list(r.stream()) == []


def test_a_run_is_observed(spark):
    acks, seen = metrics.observed(Processor(spark, Options(retry_delay=0), log(spark, 10)).poll(lambda b: 1 / (b.value - 3)))
    acks.collect()
    assert seen.get["processed.records"] == 9 and seen.get["failed.records"] == 3 and seen.get["waiting.records"] == 1


def test_commits_and_sources_are_tried_again():
    tried = []

    def refuses(n):
        tried.append(n)
        if len(tried) < 3:
            raise OSError("not yet")
        return "there"

    assert retried(lambda: refuses(1), 5) == "there" and len(tried) == 3
    tried.clear()
    assert run_with_restarts(lambda: refuses(1), timeout=1.0, wait=0.01) == "there"
    tried.clear()
    with pytest.raises(OSError):
        run_with_restarts(lambda: refuses(1))


def test_broker_options(spark):
    assert per_trigger(Options(max_concurrency=10, batch_size=2)) == 40 and per_trigger(Options(max_concurrency=10), 5) == 50
    with pytest.raises(ValueError):
        broker(spark, "x:1")
    with pytest.raises(ValueError):
        broker(spark, "x:1", topics=["a"], **{"kafka.enable.auto.commit": "true"})
