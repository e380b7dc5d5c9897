import random
import re

import corpus_pipeline
from sparrowlog.llm import language_id, mixing

WORDS = {"aa": ["re", "de", "ra", "dare", "reader", "adder"], "bb": ["um", "no", "omu", "munon", "numon", "onum"]}


def long_texts():
    rng = random.Random(8)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]


def test_language_keeps_texts_too_short_to_judge(spark):
    short = [(100, "Re.", "aa"), (101, "No", "bb"), (102, "A.", "aa"), (103, "um", "bb"), (104, "zzzz", "aa")]
    rows = [*long_texts(), *short, (110, "12 ,.", "aa"), (111, None, "aa"), (112, "", "aa"), (113, "kiwwy zlkkw pqqjx hcvvt " * 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()} == {i for i, *_ in rows} - {110, 111, 112, 113}
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.learn(df.where("doc_id < 100"))).collect()}
    assert all(got[i] == lang for i, _, lang in [*long_texts(), *short[:4]])


def test_rows_without_id_are_kept_once(spark):
    text = [" ".join(f"d{i}w{j}" for j in range(30)) for i in range(4)]
    rows = [(1, text[0], "x"), (2, text[0] + " end", "x"), (None, text[0], "x"), (None, text[1], "x"), (None, text[1] + " end", "y"), (None, text[2], "x"), (None, text[2], "x"), (4, text[3], "x"), (4, text[3], "x"), (None, "", "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.unique(spark, df, "")
    assert got.columns == df.columns
    out = sorted((str(r.doc_id), (r.text or "").removesuffix(" end")) for r in got.collect())
    assert out == sorted([("1", text[0]), ("None", text[1]), ("None", text[2]), ("4", text[3]), ("None", ""), ("5", "")])
    assert corpus_pipeline.unique(spark, df.limit(0), "").collect() == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, predicted int, n_grams int, runs int, n int, token string"


def odd_corpus():
    """Documents with columns whose names the stages use, and with every kind of odd row."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(160):
        lang = "ab"[i % 2] * 2
        words = [rng.choice(WORDS[lang]) + rng.choice("aeiou") for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            words[5:5] = ["zzvile", "yyfoul"]
        labels.append((i, int(bad)))
        rows.append((i, " ".join(words), lang, "xyz"[i % 3]))
    rows += [(1000, rows[1][1], "bb", "x"), (1001, rows[2][1] + " re", "aa", None), (None, rows[3][1], "bb", "y"), (None, None, "aa", "x"), (1002, "", "aa", "x"), (1003, "12 3", "aa", "x"), (1004, "Re.", "aa", "z"), (5, rows[5][1], "bb", "x"), (1005, rows[7][1] + " omu" * 5000, "bb", "x")]
    return [(*r, len(r[1] or ""), 0.5, "q", 1, 2, 3, 4, "t") for r in rows], labels


def test_run_against_a_plain_version(spark, tmp_path):
    rows, labels = odd_corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = docs.collect()
    # Language: only what has no letter goes; toxicity: only what was planted.
    assert len(kept["language"]) == len(rows) - 3
    assert {r.doc_id for r in kept["language"]} - {r.doc_id for r in kept["toxicity"]} == {i for i, bad in labels if bad}
    # Near duplicates: one row of each component of the brute-force graph.
    sets = []
    for r in kept["toxicity"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and 100 * len(a & b) >= 80 * len(a | b):
                part = [part[j] if p == part[i] else p for p in part]
    assert len(kept["near_duplicates"]) == len(set(part))
    first = {}
    for r, p in zip(kept["toxicity"], part):
        first[p] = min(first.get(p, (2, 0)), (r.doc_id is None, r.doc_id or 0))
    assert {(r.doc_id is None, r.doc_id or 0) for r in kept["near_duplicates"]} == set(first.values())
    # Mixing: each source's words come to its target.
    size, got = {}, {}
    for r in kept["near_duplicates"]:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    for r in kept["mixing"]:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert all(abs(got[s] - t) <= 1 for s, t in zip(names, want))
    # Pieces: as the vocabulary's own program makes them.
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path())
    out = corpus_pipeline.pieces(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(r.doc_id), sp.encode(r.text)) for r in kept["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_pieces, r.ids) for r in whole) == sorted((str(r.doc_id), len(r.ids), r.ids) for r in out)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
