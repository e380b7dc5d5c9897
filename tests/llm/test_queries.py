"""The registered queries on the smallest tables: columns, folds, and what plain code says of them."""

import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
from sparrowlog.llm.mixing import targets
from sparrowlog.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_url_filters_equal_sql(spark, tiny, duck):
    got = QUERIES["op3_url_filters"](spark, tiny).toPandas()
    want = duck.execute(ORACLE_SQL["op3_url_filters"]).fetchdf()
    order = ["page_id", "host", "fetched", "n_rules", "lists", "blocked"]
    assert sorted(map(tuple, got[order].to_numpy().tolist())) == sorted(map(tuple, want[order].to_numpy().tolist()))


def test_folds(spark, tiny, docs):
    out = QUERIES["op2_toxicity"](spark, tiny).collect()
    assert {r.doc_id for r in out} == set(docs) and all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    out = QUERIES["op8_language_id"](spark, tiny).collect()
    assert {r.doc_id for r in out} == set(docs) and all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang and re.search(r"[^\W\d_]", docs[r.doc_id].text or "")]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_mixing(spark, tiny, docs):
    out = QUERIES["op5_mixing"](spark, tiny).collect()
    size = {}
    for r in out:
        d = docs[r.doc_id]
        assert r["size"] == len(WORD.findall(d.text or "")) and 0 <= r.taken <= 2 * r["size"]
        size[d.source] = size.get(d.source, 0) + r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got = {}
    for r in out:
        s = docs[r.doc_id].source
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6
        got[s] = got.get(s, 0) + r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in names)


def test_fingerprints(spark, tiny, docs):
    import hashlib

    out = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, tiny).collect()}
    ids = sorted(docs)
    assert sorted(out) == ids
    near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for n, i in enumerate(ids):
        t, after, r = docs[i].text or "", docs[ids[(n + 1) % len(ids)]].text or "", out[i]
        half = len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert r.near_edited == near(r.fingerprint, r.edited_fingerprint) and r.near_next == near(r.fingerprint, out[ids[(n + 1) % len(ids)]].fingerprint)
        assert (r.near_docs is not None) == (i % 50 == 0)
        if i % 50 == 0:
            assert r.near_docs == sum((int(r.fingerprint, 16) ^ int(out[j].fingerprint, 16)).bit_count() <= 3 for j in ids if j != i)


def test_neighbours(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got, hits, n = {}, 0, 0
    for r in QUERIES["op10_ann"](spark, tiny).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = (x * x[ids == q][0]).sum(1)
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert sorted(found) == list(range(1, 21)) and all(v == s[ids == i][0] for i, v in found.values())
        assert [i for i, _ in (found[k] for k in sorted(found))] == sorted((i for i, _ in found.values()), key=lambda i: (-s[ids == i][0], i))
        hits, n = hits + len(set(best) & {i for i, _ in found.values()}), n + 20
    assert hits >= 0.9 * n


def test_pages(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    out = QUERIES["op6_html_text"](spark, tiny).collect()
    assert sorted(r.page_id for r in out) == sorted(r.page_id for r in pages.collect()) and all(r.n_chars == len(r.text) for r in out)
    made = QUERIES["op9_warc"](spark, tiny).collect()
    assert len(made) == 2 * len(out) and {r.warc_type for r in made} == {"metadata", "conversion"}


def test_pieces(spark, tiny, docs):
    from sentencepiece import SentencePieceProcessor

    from sparrowlog.llm.queries import tokenizer_path

    sp = SentencePieceProcessor(model_file=tokenizer_path())
    out = QUERIES["op1_piece_codec"](spark, tiny).collect()
    assert all(r.same_text and r.n_pieces == len(sp.encode(docs[r.doc_id].text or "")) for r in out) and len(out) == len(docs)
