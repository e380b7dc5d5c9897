import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from sparrowlog.llm import jaccard_join
from sparrowlog.llm._text import Powers
from sparrowlog.llm.jaccard_join import forest, jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(n)
    seen = set()
    for n, (i, s) in enumerate(sets):
        for m in {m for x in s for m in where[x] if m < n}:
            j, t = sets[m]
            both = len(s & t)
            if (i, j) not in seen and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for i, s in sets}


def test_whole_table_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_chains_copies_and_odd_texts(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, "\t".join(base).upper())]
    for i in range(12):  # a chain: each differs from the next in one word
        base = [*base]
        base[5 * i % 60] = f"x{i}"
        rows.append((20 + i, " ".join(base)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one two three four"), (7, "a"), (8, "a"), (9, "é É")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, n=1, token="x", component_id=5) for i, t in rows], "doc_id long, text string, n int, token string, component_id int")
    assert {tuple(r) for r in jaccard_components(df).collect()} == brute(rows)


def test_repeated_rows_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in jaccard_components(df).collect()))) == ["(1, 2, 1)", "(1, 2, 1)", "(2, 2, 1)", "(None, 2, 1)"]
    assert jaccard_components(df.limit(0)).collect() == []


def joined(n, edges):
    part = list(range(n))
    for a, b in edges:
        part = [part[a] if p == part[b] else p for p in part]
    return {frozenset(i for i in range(n) if part[i] == p) for p in part}


def test_forest_links_components_that_tie():
    # Windows over a line link with their neighbours only: A-B-D-C, in the order A, B, C, D.
    windows = [np.arange(i, i + 20).astype(np.uint64) for i in (0, 1, 3, 2)]
    assert joined(4, forest(np.arange(4), windows, 85)[0]) == {frozenset(range(4))}
    rng = random.Random(3)
    for _ in range(200):
        at = rng.sample(range(16), 11)
        found = forest(np.arange(11), [np.arange(i, i + 20).astype(np.uint64) for i in at], 85)[0]
        assert joined(11, found) == joined(11, [(i, j) for i in range(11) for j in range(i) if abs(at[i] - at[j]) == 1])
        assert len(found) == 11 - len(joined(11, found))


@pytest.mark.parametrize("block, hot", [(2048, 4096), (3, 4096), (3, 12)])
def test_versions_that_drift(spark, monkeypatch, block, hot):
    """Also where clusters are dealt into many blocks, and where frequent shingles are broadcast."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng, rows = random.Random(4), []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(70)]
        versions = []
        for v in range(8):
            words = [*words[1:], f"f{f}v{v}"]
            versions.append(" ".join(words))
        rows += versions
    order = rng.sample(range(len(rows)), len(rows))
    df = spark.createDataFrame([(i, rows[n]) for i, n in enumerate(order)], "doc_id long, text string")
    got = {tuple(r) for r in jaccard_components(df, percent=95).collect()}
    assert got == brute([(i, rows[n]) for i, n in enumerate(order)], 95)


def test_memory_of_hashing():
    """A worker's memory beside its batch of texts; executors have two workers or more, and came close to their limit."""
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(1500)) for _ in range(300)]  # about 3 MB
    column, powers = pa.array([*texts, None, ""]), Powers()
    powers.reach(1 << 20)
    tracemalloc.start()
    sizes = [len(x) for x in jaccard_join._sets(column, 4, powers)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [len(shingle_set(t)) for t in [*texts, None, ""]]
    assert peak < 12e6, peak
