import random
import zlib

from sparrowlog.llm import language_id, toxicity

ALPHABETS = {"aa": "abcde", "bb": "efghi", "cc": "ijkla"}


def invented(rng, letters, n=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(5)
    rows = [(i, invented(rng, ALPHABETS[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df.where("doc_id < 60"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_odd_texts(spark):
    rng = random.Random(6)
    rows = [(i, invented(rng, "abc"), "aa") for i in range(5)] + [(10, None, "aa"), (11, "", None), (12, "12 ,.", "aa"), (13, "a", "aa"), (14, "é", "aa"), (15, "x " * 100_000, None), (15, "x " * 100_000, None), (None, "abc abc", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    model = language_id.learn(df)
    out = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(df, model).collect()]
    assert len(out) == len(rows)
    assert {x for i, x, _ in out if i in (10, 11, 12)} == {"und"}
    assert {x for i, x, _ in out if i in (13, 14, 15)} == {"aa"}
    assert all(0 <= s <= 1 for _, _, s in out)
    empty = language_id.learn(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, empty).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).collect() == []


def toxic_rows(n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = invented(rng, "abcdefghij", 80).split()
        bad = i % 8 == 0
        if bad:
            for w in rng.sample(["zzvile", "yyfoul", "wwmean"], 2):
                words.insert(rng.randint(0, 79), w)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1 if bad else 0))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, "crc32(cast(doc_id as string)) % 5 <> 0")
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == (i % 8 == 0) for i in held) >= 0.95 * len(held)
    again = toxicity.learn(docs, marks, "crc32(cast(doc_id as string)) % 5 <> 0")
    assert (again.weights == model.weights).all()


def test_toxicity_odd_input(spark):
    rows, labels = toxic_rows(60)
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "zzvile " * 50_000), (1002, "zzvile " * 50_000), (None, "abc")], "doc_id long, text string").selectExpr("*", "2 as score", "9 as toxic")
    marks = spark.createDataFrame([*labels, (1002, 1), (1002, None), (None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, marks)).collect()
    assert len(out) == 65 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = toxicity.learn(docs, marks.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_risk_and_its_slope():
    """Against differences of the risk; where the negatives' part is below 0, against that part alone, uphill."""
    import numpy as np

    rng = np.random.default_rng(0)
    n_u = rng.integers(1, 5, 30)
    for shift in (0.0, 8.0):
        z_p, z_u, prior = rng.normal(size=12) + shift, rng.normal(size=30) - shift, 0.3
        value, g_p, g_u = toxicity.risk(z_p, z_u, n_u, prior)
        plus = lambda z: np.log1p(np.exp(z))
        rest = lambda a, b: (n_u * plus(b)).sum() / n_u.sum() - prior * plus(a).mean()
        whole = lambda a, b: prior * plus(-a).mean() + rest(a, b)
        assert np.isclose(value, prior * plus(-z_p).mean() + max(0, rest(z_p, z_u)))
        assert (rest(z_p, z_u) < 0) == (shift > 0)
        f, sign = (whole, 1) if shift == 0 else (rest, -1)
        for i in range(12):
            d = np.zeros(12)
            d[i] = 1e-6
            assert np.isclose(sign * (f(z_p + d, z_u) - f(z_p - d, z_u)) / 2e-6, g_p[i], atol=1e-7)
        for i in range(30):
            d = np.zeros(30)
            d[i] = 1e-6
            assert np.isclose(sign * (f(z_p, z_u + d) - f(z_p, z_u - d)) / 2e-6, g_u[i], atol=1e-7)


def test_features_and_counts_against_sets():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [invented(rng, "abcd", rng.randint(0, 30)) for _ in range(50)] + ["", None, "abc " * 5000]
    grams = {f" {t or ''} "[i : i + n] for t in texts[:5] for n in toxicity.SIZES for i in range(len(t or "") + 3 - n)}
    number = lambda g: (len(g) << 8 * len(g)) | int.from_bytes(g.encode(), "big")
    import numpy as np

    known = np.array(sorted(number(g) for g in grams), np.uint64)
    got = []
    for i, j, doc, at in toxicity._found(pa.array(texts), known, toxicity._mask(known)):
        got += [{int(known[x]) for x in at[doc == d]} for d in range(j - i)]
    want = [{number(g) for g in grams if g in f" {(t or '').strip()} "} for t in texts]
    assert got == want


def test_filters_against_plain_sets(spark):
    """Without Bloom filters: the share of a text's n-grams that each language's set holds."""
    rng = random.Random(5)
    rows = [(i, invented(rng, ALPHABETS[lang], 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df.where("doc_id < 45"))
    n = language_id.GRAM
    of = lambda t: [f" {t} "[i : i + n] for i in range(len(t) + 3 - n)]
    counts = {}
    for i, t, lang in rows[:45]:
        for g in of(t):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    share = {x: {g: c / sum(own.values()) for g, c in own.items() if c >= 2} for x, own in counts.items()}
    best = {}
    for own in share.values():
        for g, p in own.items():
            best[g] = max(best.get(g, 0), p)
    sets = {x: {g for g, p in own.items() if p >= language_id.SHARE * best[g]} for x, own in share.items()}
    for r in language_id.predict(df, model, keep=("doc_id", "text")).collect():
        plain = {x: sum(g in s for g in of(r.text)) / len(of(r.text)) for x, s in sets.items()}
        assert plain[r.lang_pred] >= max(plain.values()) - 0.02 and abs(r.score - plain[r.lang_pred]) < 0.05
