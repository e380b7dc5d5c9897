import random

from sparrowlog.llm.simhash import edited, fingerprints, within_radius, with_next


def test_next_and_edited_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab é日") for _ in range(rng.randint(0, 30)))) for i in rng.sample(range(10_000), 300)] + [(-5, None), (77, "same"), (77, "same"), (None, "nul")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as ghost", "3 as next_text")
    order = sorted(((i is not None, i or 0), t or "", i) for i, t in rows)
    want = []
    for n, (_, t, i) in enumerate(order):
        after, h = order[(n + 1) % len(order)][1], len(t) // 2
        want.append((str(i), t, after, t[: len(t) - h] + after[:h]))
    got = [(str(r.doc_id), r.text, r.next_text, r.edited) for r in edited(with_next(df)).collect()]
    assert sorted(got) == sorted(want)
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert [tuple(r) for r in edited(with_next(one)).collect()] == [(1, "abcd", "abcd", "abab")]
    assert edited(with_next(one.limit(0))).collect() == []


def test_equal_texts_and_near_texts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    near, far = [*base], ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    near[50] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(far), "", "one", " ".join(base)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    prints = {(r.k1, r.k2): (r.f1, r.f2) for r in fingerprints(df).collect()}
    assert len(prints) == 5
    keyed = {}
    for t in set(texts):
        (r,) = fingerprints(spark.createDataFrame([(t,)], "text string")).collect()
        assert prints[r.k1, r.k2] == (r.f1, r.f2)
        keyed[t] = (r.f1 % 2**64) << 64 | r.f2 % 2**64
    dist = lambda a, b: (keyed[a] ^ keyed[b]).bit_count()
    assert dist(texts[0], texts[1]) < 20 < 40 < dist(texts[0], texts[2])


def test_block_tables_find_all(spark):
    rng = random.Random(4)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [rng.getrandbits(128) for _ in range(60)]
    for b in base[:40]:
        for n in (1, 2, 3, 4):
            x = b
            for i in rng.sample(range(128), n):
                x ^= 1 << i
            base.append(x)
    df = spark.createDataFrame([(signed(x >> 64), signed(x % 2**64)) for x in base + base[:3]], "f1 long, f2 long")
    want = {(a, b, (a ^ b).bit_count()) for a in base[:30] for b in base if (a ^ b).bit_count() <= 3}
    q = df.limit(30)
    for agree in (1, 2):
        got = [((r.q1 % 2**64) << 64 | r.q2 % 2**64, (r.f1 % 2**64) << 64 | r.f2 % 2**64, r.distance) for r in within_radius(q, df, 3, agree).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fingerprint_bit_by_bit(spark):
    import struct

    import xxhash

    from sparrowlog.llm.simhash import LONG_WORD

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    one = lambda data, seed=42: signed(xxhash.xxh64(data, seed=seed % 2**64).intdigest())
    long = lambda x, seed=42: one(struct.pack("<q", x), seed)
    small = lambda x, seed: one(struct.pack("<i", x), seed)

    def brute(text):
        words = (text or "").lower().strip(" \t\n\f\r")
        import re

        hashed = [(one(w.encode()) & -2) | (len(w) >= LONG_WORD) for w in re.split(r"[ \t\n\x0b\f\r]+", words)]
        votes, total = [0] * 128, 0
        for a, b in zip(hashed, [*hashed[1:], None]):
            # A null leaves the hash as it was.
            t = ((long(a) if b is None else long(b, long(a))) & -2) | (a & (b or 0) & 1)
            w = 1 + (t & 1)
            total += w
            h = [small(11, long(t)) % 2**64, small(23, long(t)) % 2**64]
            for i in range(128):
                votes[i] += w * (h[i // 64] >> i % 64 & 1)
        f = [sum(1 << i for i in range(64) if 2 * votes[64 * k + i] > total) for k in (0, 1)]
        return signed(f[0]), signed(f[1])

    rng = random.Random(8)
    texts = ["", "one", "Two  words", "é É ß", "x " * 3000] + [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    for t in texts:
        (r,) = fingerprints(spark.createDataFrame([(t,)], "text string")).collect()
        assert (r.f1, r.f2) == brute(t)


def test_ranges_by_halving(spark):
    """Many ranges, ids in clusters, and repeats at their edges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, f"t{i}") for i in [*range(50), *range(10**12, 10**12 + 50), 7, 7, 49]]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 37)
        got = sorted((r.doc_id, r.text, r.next_text) for r in with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows)
    assert got == sorted((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
