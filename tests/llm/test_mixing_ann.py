import numpy as np
from pyspark.sql import functions as F

from sparrowlog.llm.ann import nearest
from sparrowlog.llm.mixing import Permutation, mix, mixed_documents, shard_counts, taken, targets


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == [200, 250 * 2 / 3, 250 / 3]
    assert targets([10, 0], [1, 1]) == [15.0, 0.0] and targets([], []) == []


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 64, 1000):
        p = Permutation(n, 42)
        x = p(np.arange(n))
        assert sorted(x) == list(range(n)) and (p(x, back=True) == np.arange(n)).all()


def test_shards():
    c = shard_counts([100, 5, 0, 895], 7, 1)
    assert c.sum(0).tolist() == [100, 5, 0, 895] and (c >= 0).all()
    assert shard_counts([0], 3, 1).sum() == 0


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(int(rng.integers(0, 90)))), "abcde"[min(4, int(rng.exponential(1.2)))]) for i in range(300)]
    rows += [(900, None, "a"), (901, "", None), (902, "x y", None), (902, "x y", None), (None, "p q r", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as start", "3 as src", "4 as h")
    m = mix(df, block=16, shards=5)
    out = taken(m).collect()
    assert len(out) == len(rows)
    got, size, want = {}, {}, {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + r.taken
        size[r.source], want[r.source] = r.source_size, r.target
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(want.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(abs(got[s] - want[s]) <= 1 for s in got)
    again = taken(mix(df.repartition(7), block=16, shards=5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    docs = mixed_documents(df.drop("size", "start", "src", "h"), m)
    words = docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: n for s, n in got.items() if n}
    assert taken(mix(df.limit(0))).collect() == []


def brute(rows, k, every):
    ids = np.array([i for i, v in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = []
    for n in np.flatnonzero(ids % every == 0):
        s = (x * x[n]).sum(1)
        c = np.flatnonzero(ids != ids[n])
        best = c[np.lexsort((ids[c], -s[c]))][:k]
        out += [(int(ids[n]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(best)]
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[100:180] = x[100]  # many equal ones
    x[200] *= 30
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [None] * 32), (2080, [1.0]), (2100, []), (None, rows[0][1]), (2120, [float("inf")] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as score", "3 as rank")
    got = [tuple(r)[:4] for r in nearest(df, 20, 20).collect()]
    want = brute(rows, 20, 20)
    assert len(got) == len(want)
    hits = {(q, v) for q, _, v, _ in want}
    assert sum((q, v) in hits for q, _, v, _ in got) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in brute(rows, 1499, 20)}
    assert all(exact[q, v] == s for q, _, v, s in got)
    assert [g for g in sorted(got) if g[0] == 100] == [w for w in sorted(want) if w[0] == 100]
    few = nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), 20, 2)
    assert few.count() == 4
    assert nearest(df.limit(0)).collect() == []


def test_many_blocks_and_lots(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((8, 24))[i % 8] + 0.3 * rng.standard_normal(24) for i in range(2000)]).reshape(2000, 24)
    x[:600] = x[0]  # a third are equal, so one cell has them all
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest(df, 20, 20, block=100, lot=7).collect()
    want = brute(rows, 20, 20)
    hits = {(q, v) for q, _, v, _ in want}
    assert len(out) == len(want) == 2000
    assert sum((r.query_id, r.vec_id) in hits for r in out) >= 0.9 * len(want)
    assert np.mean([r.verified for r in out]) < 0.5 * len(rows)
    assert sorted(tuple(r)[:3] for r in out if r.query_id < 600) == [w[:3] for w in sorted(want) if w[0] < 600]


def test_large_norms_keep_their_order(spark):
    rng = np.random.default_rng(3)
    x = 1e8 * rng.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()
    exact = {(q, v): s for q, _, v, s in brute(rows, 399, 50)}
    assert all(abs(exact[r.query_id, r.vec_id] / r.score - 1) < 1e-12 for r in got)


def test_stream_order_is_no_setting(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 70)), "abc"[i % 3]) for i in range(200)], "doc_id long, text string, source string")
    seen, before = set(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 37, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(map(str, taken(mix(df, block=16, shards=5)).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
