"""The relational lattice gives what the vocabulary's own program and the batch kernel give."""

import random

import numpy as np
import pytest

from sparrowlog.llm.lattice import encode_relations, pieces_of
from sparrowlog.llm.piece_codec import Lattice, PieceTable, load_model

PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_relations_give_the_library_s_ids(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    texts = ["", None, " ", "   ", "a", "\n", "  lead  and trail  ", "日本語のテキストです。", "x" * 40, "===" * 9, "😀 emoji", "á é", "<s> </s> <0x41>", "the" * 12]
    texts += ["".join(rng.choice("abcdefgh \t\n-=#/é日😀aeinrst ") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = sorted((r.doc_id, r.ids) for r in encode_relations(df, load_model(PATH)).collect())
    assert got == sorted((i, sp.encode(t or "")) for i, t in enumerate(texts) for _ in range(2))
    assert encode_relations(df.limit(0), load_model(PATH)).collect() == []


def test_viterbi_by_aggregate(spark):
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -2.2, "ba": -1.1, "aba": -3.0, "▁a": -2.5, "bb": -5.0}
    order = sorted(pieces, key=lambda p: -pieces[p])
    table = PieceTable(order, np.arange(len(order), dtype=np.int32), np.array([pieces[p] for p in order]), np.full(256, -1, np.int32), 99, "unigram", [])
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 12))) for _ in range(60)})
    got = {r.word: r.ids for r in pieces_of(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    kernel = Lattice(table)
    for w in words:
        chars = np.array([ord(c) for c in w], np.uint32)
        ids, _ = kernel.words(chars, np.array([0]), np.array([len(w)]))
        score = lambda x: sum(table.scores[i] if i < 99 else min(table.scores) - 10 for i in x)
        assert abs(score(got[w]) - score(ids.tolist())) < 1e-9 and sum(len(order[i]) if i < 99 else 1 for i in got[w]) == len(w)
