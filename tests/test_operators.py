"""Known values of selection, progress, retry and reconciliation."""

import pytest
from pyspark.sql import functions as F

from sparrowlog.model import CommitMode, Options, Ordering
from sparrowlog.operators import flow, offsets, reconcile, retry, shards

LOG = "topic string, part int, k string, off long, fails long"


def log(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], LOG)


SPARSE = [(1, "key-0", 0, 0), (1, "key-0", 1, 0), (1, "key-0", 2, 0), (2, "a", 6, 0), (2, "b", 8, 0), (2, "a", 10, 0), (2, "c", 12, 0), (2, "a", 15, 0), (2, "c", 20, 0)]


def test_rounds_by_key(spark):
    got = {}
    for r in shards.rounds(log(spark, SPARSE), Ordering.KEY).collect():
        got.setdefault(r.round, set()).add(r.off)
    assert got == {1: {0, 6, 8, 12}, 2: {1, 10, 20}, 3: {2, 15}}


@pytest.mark.parametrize(("ordering", "want"), [(Ordering.UNORDERED, {0, 1, 2}), (Ordering.PARTITION, {0}), (Ordering.KEY, {0})])
def test_selection(spark, ordering, want):
    work = log(spark, SPARSE[:3]).withColumn("succeeded", F.lit(False))
    assert {r.off for r in shards.eligible(work, ordering).collect()} == want
    after = work.withColumn("succeeded", F.col("off") == 0)
    assert {r.off for r in shards.eligible(after, ordering).collect()} == ({1, 2} if ordering is Ordering.UNORDERED else {1})


def test_failing_head_blocks_until_its_delay_has_passed(spark):
    work = log(spark, SPARSE[:3]).withColumn("succeeded", F.lit(False)).withColumn("attempts", F.expr("if(off = 0, 1L, 0L)")).withColumn("last_failed_us", F.lit(5_000_000))
    work = retry.due(work)
    head = lambda now: {r.off for r in shards.eligible(work, Ordering.KEY, retry.ready(now)).collect()}
    assert head(5_999_999) == set() and head(6_000_000) == {0}


def test_taking_goes_round_the_shards(spark):
    work = log(spark, [(p, f"k{p}", o, 0) for p in range(3) for o in range(3)]).withColumn("succeeded", F.lit(False))
    heads = shards.eligible(work, Ordering.PARTITION)
    assert [r.part for i in range(3) for r in shards.take_fair(heads, Ordering.PARTITION, 1, resume=i).collect()] == [0, 1, 2]
    assert {r.part for r in shards.take_fair(heads, Ordering.PARTITION, 2).collect()} == {0, 1}


def test_null_key_is_a_shard(spark):
    rows = log(spark, [(0, None, 1, 0), (0, None, 2, 0), (0, "a", 3, 0)])
    assert sorted((str(r.k), r.n) for r in shards.shard_sizes(rows, Ordering.KEY).collect()) == [("None", 2), ("a", 1)]
    assert [r.off for r in shards.take_fair(rows, Ordering.KEY, 10).orderBy("turn").collect()] == [1, 2, 3]


TODO = [11, 15, 20, 60, 80, 95, 96, 97, 98, 100]


def state_work(spark):
    rows = [("t", 0, o, o not in TODO) for o in range(11, 102)]
    return spark.createDataFrame(rows, "topic string, part int, off long, succeeded boolean")


def test_state(spark):
    s = offsets.partition_state(state_work(spark)).first()
    assert (s.highest_seen, s.highest_succeeded, s.incompletes, s.sequential, s.to_commit) == (101, 101, 10, 10, 11)
    none = offsets.partition_state(state_work(spark).where("off = 11")).first()
    assert (none.highest_succeeded, none.to_commit) == (-1, 11)
    done = offsets.partition_state(state_work(spark).where("succeeded")).first()
    assert done.to_commit == 102


def test_compaction_and_truncation(spark):
    todo = offsets.incompletes(state_work(spark))
    polled = spark.createDataFrame([("t", 0, o) for o in range(11, 99) if o not in (80, 95, 97)], "topic string, part int, off long")
    assert sorted(r.off for r in reconcile.compact(todo, polled).collect()) == [11, 15, 20, 60, 96, 98, 100]
    first = lambda f: spark.createDataFrame([("t", 0, f, 11)], "topic string, part int, first long, committed long")
    assert sorted(r.off for r in reconcile.truncate(todo, first(20)).collect()) == [o for o in TODO if o >= 20]
    assert reconcile.truncate(todo, first(6)).count() == 0
    assert [reconcile.bootstrap(first(f)).first().outcome for f in (6, 11, 20)] == ["rewound", "as committed", "truncated"]


def test_fence_and_revoke(spark):
    work = spark.createDataFrame([("t", 0, 1, 0), ("t", 0, 2, 1), ("t", 1, 3, 0)], "topic string, part int, off long, epoch long")
    now = spark.createDataFrame([("t", 0, 1)], "topic string, part int, epoch long")
    fresh, stale = reconcile.fence(work, now)
    assert [r.off for r in fresh.collect()] == [2] and sorted(r.off for r in stale.collect()) == [1, 3]
    assert [r.off for r in reconcile.revoke(work, now).collect()] == [3]


def test_retry_queue_holds_a_record_once(spark):
    f = spark.createDataFrame([("t", 0, 1, 1, 10), ("t", 0, 1, 2, 20), ("t", 0, 2, 1, 15)], "topic string, part int, off long, attempt int, retry_due long")
    assert [(r.off, r.attempt) for r in retry.queue(f).orderBy("retry_due").collect()] == [(2, 1), (1, 2)]


def test_options():
    assert Options().interval == 5 and Options(commit_mode=CommitMode.TRANSACTION).interval == 0.1
    assert Options(max_concurrency=2, batch_size=3).target == 6
    assert Options(buffer_size=100).load_factor() == 7
    for bad in (Options(batch_size=0), Options(eager_during_commit=True), Options(first_load_factor=5, most_load_factor=4), Options(retry_delay=-1)):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(ValueError):
        Options().validate(sink=True, has_sink=False)
    assert shards.request(10, 4, 4) == 8 and shards.request(10, 12) == 0


def test_load_factor_and_rate():
    f = flow.LoadFactor()
    assert [f.offer(t, True, True) for t in (1, 2, 2.1, 4.1, 4.2, 5)] == [False, False, True, False, True, False] and f.factor == 4
    assert not f.offer(10, False, True) and flow.loaded(40, 30, 32, 2) and not flow.loaded(40, 24, 32, 2)
    r = flow.RateLimiter(1.0)
    assert [r.allow(t) for t in (0, 0.5, 1.0)] == [True, False, True]


def test_scan_open_shards_and_order(spark):
    rows = [("t", p, k, o, 0, o != 1, 1 if o < 4 else 2) for p in (0, 10, 2) for k, o in (("a", 1), ("a", 4), ("b", 2), ("b", 3))]
    work = spark.createDataFrame(rows, "topic string, part int, k string, off long, fails long, succeeded boolean, epoch long")
    assert sorted((r.part, r.k, r.open) for r in shards.open_shards(work, Ordering.KEY).collect()) == [(0, "a", 1), (2, "a", 1), (10, "a", 1)]
    assert shards.open_shards(work, Ordering.PARTITION).count() == 3
    assert [r.part for r in shards.natural_order(work).where("off = 1").collect()] == [0, 2, 10]
    todo = work.withColumn("succeeded", F.lit(False))
    now = spark.createDataFrame([("t", 0, 2), ("t", 2, 1)], "topic string, part int, epoch long")
    state = spark.createDataFrame([("t", 0, 9, False), ("t", 2, 2, False)], "topic string, part int, highest_succeeded long, allowed boolean")
    assert sorted((r.part, r.off) for r in shards.scan(todo, Ordering.KEY, epochs=now, state=state).collect()) == [(0, 4), (2, 1)]


def test_giving_up_partitions(spark):
    work = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in range(2)], "topic string, part int, off long")
    paid = spark.createDataFrame([("t", p, 1, None) for p in (0, 1)], "topic string, part int, to_commit long, metadata string")
    epochs = spark.createDataFrame([("t", p, 4) for p in (0, 1)], "topic string, part int, epoch long")
    gone = paid.where("part = 1")
    commits, left, moved = reconcile.give_up(work, paid, epochs, gone)
    assert [r.part for r in commits.collect()] == [1] and {r.part for r in left.collect()} == {0} and {r.part: r.epoch for r in moved.collect()} == {0: 4, 1: 5}
    assert reconcile.give_up(work, paid, epochs, gone, lost=True)[0].count() == 0


def test_every_meter(spark):
    from sparrowlog.functions import codec
    from sparrowlog.operators import metrics

    rows = [("t", p, "k", o, o % 3 == 0, 1, o % 3 == 1, 100, 0) for p in (0, 1) for o in range(10)]
    work = spark.createDataFrame(rows, "topic string, part int, k string, off long, succeeded boolean, attempts long, in_flight boolean, took_us long, taken_us long")
    epochs = spark.createDataFrame([("t", 0, 3)], "topic string, part int, epoch long")
    paid = codec.payloads(offsets.partition_state(work), offsets.incompletes(work))
    got = metrics.meters(work, Ordering.KEY, paid, epochs, Options(tags={"app": "x"}), status=2, factor=5, paused=1, now_us=20_000_000).collect()
    assert {r.meter for r in got} == {m for ms in metrics.METERS.values() for m in ms} and len({m for ms in metrics.METERS.values() for m in ms}) == 24
    value = {(r.meter, r.tags.get("partition") or r.tags.get("encoding")): r.value for r in got}
    assert value["slow.records", "0"] == 3 and value["assignment.epoch", "0"] == 3 and value["assignment.epoch", "1"] is None and value["waiting.records", None] == 6
    assert value["payload.ratio.used", "0"] == 8 / 8 and value["dynamic.load.factor", None] == 5 and all(r.tags["app"] == "x" for r in got)
    reg = metrics.Registry({"app": "x"})
    reg.add("processed.records", 2, topic="t")
    reg.add("processed.records", 3, topic="t")
    reg.set("status", 1)
    assert reg.get("processed.records", topic="t") == 5 and reg.get("status") == 1
    reg.remove("status")
    assert reg.get("status") is None
    reg.close()
    assert reg.get("processed.records", topic="t") is None
