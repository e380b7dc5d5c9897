import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from sparrowlog.llm.piece_codec import Lattice, PieceTable, decode, encode, kind_of, load_model

PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
ODD = ["", None, " ", "   ", "a", "\n", "  lead  and trail  ", "日本語のテキストです。", "x" * 300, "ab" * 500, "===" * 100, "😀 emoji", "á é", "<s> </s> <0x41>", "\x00", "the" * 40, "0123456789" * 20, "word " * 3000]


@pytest.fixture(scope="module")
def model():
    return load_model(PATH)


def texts():
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdefgh \t\n-=#/é日😀") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    return ODD + some + ["".join(rng.choice("aeinrst ") for _ in range(rng.randint(1, 300))) for _ in range(200)]


def test_same_ids_as_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = []
    for ids, off in Lattice(model).encode(pa.array(texts(), pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    assert got == [sp.encode(t or "") for t in texts()]


def test_kind_comes_from_the_file(model, tmp_path):
    assert model.kind == "bpe" and kind_of(open(PATH, "rb").read()) == "bpe"
    # Settings (field 2) whose type (field 3) says unigram, word, or nothing, which means unigram.
    assert kind_of(b"\x12\x02\x18\x01") == "unigram" and kind_of(b"") == "unigram"
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x03")
    with pytest.raises(ValueError, match="word"):
        load_model(str(tmp_path / "m"))


def test_round_trip_with_extra_columns_and_repeats(spark, model):
    rows = [Row(doc_id=i, text=t, ids="clash", decoded=1) for i, t in enumerate(texts()[:80])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    back = decode(encode(df, model), model)
    want = sorted((i, t or "") for i, t in enumerate(texts()[:80]) for _ in range(2))
    assert sorted((r.doc_id, r.decoded) for r in back.collect()) == want
    assert encode(df.limit(0), model).collect() == []


def test_viterbi_against_every_path():
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -2.2, "ba": -1.1, "aba": -3.0, "▁a": -2.5, "bb": -5.0}
    order = sorted(pieces, key=lambda p: -pieces[p])
    import numpy as np

    table = PieceTable(order, np.arange(len(order), dtype=np.int32), np.array([pieces[p] for p in order]), np.full(256, -1, np.int32), 99, "unigram", [])
    lattice = Lattice(table)

    def best(word):
        paths = [(0.0, [])]
        out = []

        def walk(i, score, path):
            if i == len(word):
                out.append((score, path))
                return
            for p in order:
                if word.startswith(p, i):
                    walk(i + len(p), score + pieces[p], [*path, p])

        walk(0, *paths[0])
        return max(out)[0]

    rng = random.Random(3)
    for _ in range(50):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
        ((ids, _),) = lattice.encode(pa.array([t]))
        assert abs(sum(pieces[order[i]] for i in ids) - best("▁" + t.replace(" ", "▁"))) < 1e-9
        assert "".join(order[i] for i in ids) == "▁" + t.replace(" ", "▁")
