"""Codecs: known run lengths, sizes and round trips."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowlog.functions import codec
from sparrowlog.model import ForeignMetadata
from sparrowlog.operators import offsets

NAMES = [*codec.PLAIN, *(f"{n}Compressed" for n in codec.PLAIN)]


@pytest.mark.parametrize(("todo", "runs"), [({0, 4, 6, 7, 8, 10}, [1, 3, 1, 1, 3, 1, 1]), ({0, 6, 10}, [1, 5, 1, 3, 1]), (set(), [0, 11])])
def test_runs(todo, runs):
    assert codec.runs_of(codec.bits_of(0, 11, todo)) == runs


def test_runs_with_gaps():
    todo = {0, 6, 8, 10}
    assert codec.runs_with_gaps((o, o not in todo) for o in range(11) if o not in (2, 7)) == [1, 5, 3, 1, 1]


def test_picture():
    assert codec.from_picture(2, "ooxxoxox") == [2, 3, 6, 8]
    assert codec.picture(codec.bits_of(2, 8, [2, 3, 6, 8])) == "ooxxoxox"


def test_bitset_layout():
    body = codec.encode_body("BitSet", codec.bits_of(0, 11, {0, 4, 6, 7, 8, 10}))
    assert body == bytes([0, 11, 0b00101110, 0b00000010, 0])
    assert codec.encode_body("BitSet", codec.bits_of(0, 40_000, [])) is None


def test_small_payload():
    data = codec.encode(0, 200, [0, 2, 3])
    assert len(base64.b64decode(data)) < 10 + 1 and codec.decode(0, data) == (200, [0, 2, 3])


@pytest.mark.parametrize("highest", [10_000, 100_000, 1_000_000])
@pytest.mark.parametrize("name", NAMES)
def test_long_ranges(highest, name):
    todo = [123, 2345, 8765]
    if name.startswith(("BitSet", "RunLength")) and "V2" not in name and highest > 32_767:
        with pytest.raises(ValueError):
            codec.encode(123, highest, todo, name)
    else:
        assert codec.decode(123, codec.encode(123, highest, todo, name)) == (highest, todo)


def test_base_above_highest():
    assert codec.base_and_length(123, 122) == (123, 0) and codec.base_and_length(123, -1) == (123, 1)
    assert codec.decode(123, codec.encode(123, 122, [])) == (122, [])
    assert codec.decode(5, None) == (4, [])


def test_foreign_and_unknown_metadata():
    theirs = base64.b64encode(bytes([2, 0])).decode()
    with pytest.raises(ValueError):
        codec.decode(7, theirs)
    assert codec.decode(7, theirs, ForeignMetadata.IGNORE) == (7, [])
    for raw in (b"Lxx", b"?xx"):
        with pytest.raises(ValueError):
            codec.decode(7, base64.b64encode(raw).decode())


@settings(max_examples=60, deadline=None)
@given(st.text("xo", min_size=1, max_size=3000), st.integers(0, 10**12), st.sampled_from([None, *NAMES]))
def test_round_trip(xo, base, name):
    todo, highest = codec.from_picture(base, xo), base + len(xo) - 1
    assert codec.decode(base, codec.encode(base, highest, todo, name)) == (highest, todo)


def test_relational_sizes_are_the_bytes(spark):
    """Also of the compressed forms, which long ranges with many runs get."""
    rows = [("t", p, o, not (o * (p + 3)) % 7 < 3 or o == n - 1) for p, n in enumerate((500, 500, 3000, 40_000)) for o in range(n)]
    work = spark.createDataFrame(rows, "topic string, part int, off long, succeeded boolean")
    state = offsets.partition_state(work)
    todo = {}
    for r in offsets.incompletes(work).collect():
        todo.setdefault(r.part, []).append(r.off)
    facts = {s.part: s for s in state.collect()}
    sizes = codec.sizes(work, state)
    for r in sizes.collect():
        s = facts[r.part]
        runs = codec.runs_between(s.to_commit, s.highest_succeeded - s.to_commit + 1, todo[r.part])
        assert len(codec.smallest(sum(runs), runs, r.encoding)[1]) == r.size
    for r in codec.choose(sizes).collect():
        s = facts[r.part]
        data = codec.encode(s.to_commit, s.highest_succeeded, todo[r.part])
        assert len(data) == r.chars and codec.NAME[base64.b64decode(data)[0]] == r.encoding
    assert any(r.encoding.endswith("Compressed") for r in codec.choose(sizes).collect())


def test_ranges_of_any_length(spark):
    """One record that is stuck for a billion others."""
    top = 10**9
    work = spark.createDataFrame([("t", 0, 5, False), ("t", 0, 6, True), ("t", 0, top, True), ("t", 0, top + 9, False), ("t", 1, 3, True)], "topic string, part int, off long, succeeded boolean")
    state = offsets.partition_state(work)
    runs = sorted((r.part, r.run, r.done, r.begins, r.n) for r in codec.run_lengths(work, state).collect())
    assert runs == [(0, 1, False, 0, 1), (0, 2, True, 1, top - 5)]
    (c,) = codec.choose(codec.sizes(work, state)).collect()
    assert (c.encoding, c.size) == ("RunLengthV2", 8)
    assert [r.off for r in codec.decode_runs(codec.run_lengths(work, state), state).collect()] == [5]
    paid = {r.part: r for r in codec.payloads(state, offsets.incompletes(work)).collect()}
    assert codec.decode(5, paid[0].metadata) == (top, [5]) and paid[1].metadata is None and paid[1].allowed


@settings(max_examples=40, deadline=None)
@given(st.text("xo", min_size=1, max_size=200))
def test_runs_from_incompletes_alone(xo):
    todo = codec.from_picture(7, xo)
    assert codec.runs_between(7, len(xo), todo) == codec.runs_of(codec.bits_of(7, len(xo), todo))


def test_helpers():
    data = codec.byte_array(codec.bits_of(0, 5000, [1, 7]))
    assert len(data) == 5000
    for name, (pack, unpack) in codec.HELPERS.items():
        packed = pack(data)
        assert len(packed) < 500 and (unpack(packed, len(data)) if name == "snappy" else unpack(packed)) == data
    assert codec.decode_or_none(5, "?") == (4, []) == codec.decode_or_none(5, "bAA=")[:2]


def test_pressure_of_a_partition(spark):
    """Offsets 0 and 2 unfinished, then only 0, in a forced bitset of 100, 150 and 275 records against 40 characters."""
    got = []
    for n, left in ((100, {0, 2}), (150, {0}), (275, {0}), (275, set())):
        work = spark.createDataFrame([("t", 0, o, o not in left) for o in range(n)], "topic string, part int, off long, succeeded boolean")
        (p,) = codec.payloads(offsets.partition_state(work), offsets.incompletes(work), limit=40, forced="BitSetV2").collect()
        got.append((p.chars, p.metadata is not None, p.allowed))
    assert got == [(28, True, True), (36, True, False), (56, False, False), (0, False, True)]


def test_pressure(spark):
    df = spark.createDataFrame([(20,), (26,), (34,), (51,)], "n int").withColumn("chars", codec.chars("n - 1"))
    got = [(r.chars, r.outcome) for r in codec.pressure(df, limit=40).orderBy("n").collect()]
    assert got == [(28, "allow"), (36, "keep and block"), (48, "strip and block"), (68, "strip and block")]
    none = codec.pressure(df.withColumn("left", codec.F.lit(0)), limit=40, incompletes="left")
    assert {r.outcome for r in none.collect()} == {"nothing to keep"}
