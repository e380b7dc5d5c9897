"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts have a label; all others are unlabelled, a mixture
with the class prior p of toxic ones.  The risk is
``p E+[l(z)] + max(0, Eu[l(-z)] - p E+[l(-z)])``: the second part estimates
the risk on negatives from unlabelled texts, and where it turns negative its
gradient is followed the other way, which stops overfitting.

All unlabelled texts are dealt into bags of about BAG texts.  Each bag trains a
linear numpy classifier over letter n-grams in a task of its own, against the
same confirmed texts; the model is the mean of the classifiers' weights, summed
by Spark.  So every text that may be learned from counts, and the driver's work
does not grow with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sent, tidy, tidy_group, with_text, written
from ._text import byte_grams, chunks, counted, gram_pairs, letter_stream, letter_table, mix, utf8

#: Bytes of the n-grams.
SIZES = (4, 6)
#: Unlabelled texts of a bag, on average.
BAG = 4_000
#: A gram is a feature if it is in so many confirmed texts, this many standard errors more frequent there, and about this share of its texts toxic.
LEAST_TEXTS, LEAST_GAP, LEAST_SHARE = 3, 6.0, 0.5
#: Bits of the bitmap that n-grams pass before they are looked up.
BITS = 22
STEPS, RATE, DECAY = 150, 0.05, 1e-4


@dataclass
class ToxicModel:
    """``grams`` ascending, with ``weights``; ``mask`` a bitmap of hashed grams."""

    grams: np.ndarray
    mask: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _bit(g: np.ndarray) -> np.ndarray:
    return (mix(g) >> np.uint64(64 - BITS)).astype(np.int64)


def _mask(grams: np.ndarray) -> np.ndarray:
    m = np.zeros(1 << BITS, bool)
    m[_bit(grams)] = True
    return m


def _found(column: pa.Array, grams: np.ndarray, mask: np.ndarray):
    """(texts from, to, text index, feature index), each pair once."""
    data, off = utf8(column)
    table = letter_table()
    for i, j in chunks(off):
        x, bounds = letter_stream(data[off[i] : off[j]], off[i : j + 1] - off[i], table)
        keys = []
        for n in SIZES if len(grams) else ():
            g, doc = byte_grams(x, bounds, n)
            hit = mask[_bit(g)]
            g, doc = gram_pairs(g[hit], doc[hit])
            at = np.searchsorted(grams, g)
            at[at == len(grams)] = 0
            ok = grams[at] == g
            keys.append(doc[ok] * len(grams) + at[ok])
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield i, j, key // max(len(grams), 1), key % max(len(grams), 1)


def learn(docs: DataFrame, labels: DataFrame, allowed: str = "true", text: str = "text", key: str = "doc_id", positives: int = 4000) -> ToxicModel:
    """A model from ``docs`` and from the rows of ``labels`` with toxic = 1.

    ``allowed``: SQL over the key, for the rows that may be learned from.  The
    prior is the share of toxic ones among allowed labels.  ``positives`` bounds
    the confirmed texts, those whose hashed key comes first; features are n-grams
    of these, so they bound the driver's and the executors' memory too.  How
    frequent a feature is elsewhere is counted over all allowed texts, and all of
    them are learned from as unlabelled: texts of all kinds, so that the prior
    holds for them; confirmed ones among them count on both sides.  Rows with a
    null key or text are not learned from, repeated rows count each.  Without a
    confirmed text every score is the prior.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic")).where("key is not null and toxic is not null").where(allowed.replace(key, "key"))
    known = known.groupBy("key").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = float(n_toxic or 0) / n if n else 0.0
    some = known.where("toxic = 1").select("key").orderBy(F.xxhash64("key"), F.col("key")).limit(positives)
    base = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).where(allowed.replace(key, "key"))
    confirmed = written(base.join(F.broadcast(some), "key", "left_semi").select("text"), "confirmed")  # at most ``positives`` ids

    def none() -> ToxicModel:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(1 << BITS, bool), np.zeros(0), float(np.log(p / (1 - p))), prior)

    def count(batches):
        table, held, texts = letter_table(), [], 0
        for b in batches:
            data, off = utf8(b.column(0))
            texts += b.num_rows
            for i, j in chunks(off):
                x, bounds = letter_stream(data[off[i] : off[j]], off[i : j + 1] - off[i], table)
                for size in SIZES:
                    held.append(counted([gram_pairs(*byte_grams(x, bounds, size))[0]]))
        held.append((np.zeros(1, np.uint64), np.array([texts])))  # gram 0 counts texts
        grams, c = counted([h[0] for h in held], [h[1] for h in held])
        for lo in range(0, len(grams), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(grams[lo : lo + (1 << 16)].view(np.int64)), pa.array(c[lo : lo + (1 << 16)])], ["gram", "p"])

    # What is in a few confirmed texts at least: their number bounds it.
    often = confirmed.mapInArrow(tidy(count), "gram long, p long").groupBy("gram").agg(F.sum("p").alias("p")).where(f"gram = 0 or p >= {LEAST_TEXTS}").toPandas()
    of = often["gram"].to_numpy(np.int64)
    n_p = int(often["p"].to_numpy()[of == 0].sum())
    if not n_p:
        return none()
    order = np.argsort(of.view(np.uint64))
    grams, held_by = of.view(np.uint64)[order], often["p"].to_numpy(np.int64)[order]
    grams, held_by = grams[grams != 0], held_by[grams != 0]
    shared = spark.sparkContext.broadcast((grams, _mask(grams)))

    def among_all(batches):
        grams, mask = shared.value
        c, texts = np.zeros(len(grams) + 1, np.int64), 0
        for b in batches:
            texts += b.num_rows
            for _, _, _, at in _found(b.column(0), grams, mask):
                c += np.bincount(at, minlength=len(c))
        c[-1] = texts
        own = np.flatnonzero(c)
        for lo in range(0, len(own), 1 << 16):
            part = own[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(c[part])], ["at", "u"])

    u = np.zeros(len(grams) + 1, np.int64)
    rows = base.select("text").mapInArrow(tidy(among_all), "at long, u long").groupBy("at").agg(F.sum("u").alias("u")).toPandas()
    u[rows["at"].to_numpy()] = rows["u"].to_numpy()
    nu, u = int(u[-1]), u[:-1]
    # How far a gram's share among confirmed texts is above its share among all, in standard errors;
    # and, by the prior, the share of toxic ones among all texts that hold it.
    gap = (held_by / n_p - u / nu) / np.sqrt((held_by + u + 1.0) / (n_p + nu) / min(n_p, nu))
    picked = (gap >= LEAST_GAP) & (prior * held_by / n_p >= LEAST_SHARE * (u + 1.0) / nu)
    grams = grams[picked]
    chosen = spark.sparkContext.broadcast((grams, _mask(grams)))

    def features(batches):
        grams, mask = chosen.value
        for b in batches:
            for i, j, doc, feature in _found(b.column(0), grams, mask):
                cut = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut, pa.array(feature.astype(np.int32))), *(c.slice(i, j - i) for c in b.columns[1:])], ["features", *b.schema.names[1:]])

    positive = _sorted([np.asarray(x, np.int64) for x in confirmed.mapInArrow(tidy(features), "features array<int>").toPandas()["features"]])
    to_bags = spark.sparkContext.broadcast(positive)
    bags, p, width = max(1, -(-nu // BAG)), min(max(prior, 1e-3), 0.5), len(grams)

    def train(t: pa.Table) -> pa.Table:
        # The order in which rows come must not show in the sums; of texts with equal features one row with their number came.
        parts = [np.asarray(x, np.int64) for x in t["features"].to_numpy()]
        order = sorted(range(len(parts)), key=lambda i: parts[i].tobytes())
        n = t["n"].to_numpy()
        w, b = train_bag(to_bags.value, [parts[i] for i in order], n[order], width, p)
        on = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.append(on, -1)), "w": pa.array(np.append(w[on], b))})

    dealt = base.select("text", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(bags)).cast("int").alias("bag")).mapInArrow(tidy(features), "features array<int>, bag int")
    dealt = dealt.groupBy("bag", "features").agg(F.count("*").alias("n"))
    # Bags are small but slow, so their number of tasks is asked for, not left to the size of rows.
    dealt = dealt.repartition(min(bags, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), "bag")
    # Sums of whole numbers do not depend on the order of tasks.
    fitted = dealt.groupBy("bag").applyInArrow(tidy_group(train), "at long, w double").groupBy("at").agg(F.sum(F.round(F.col("w") * (1 << 40)).cast("decimal(38,0)")).cast("double").alias("w")).toPandas()
    w = np.zeros(width + 1)
    w[fitted["at"].to_numpy()] = fitted["w"].to_numpy() / (1 << 40) / bags
    return ToxicModel(grams, _mask(grams), w[:-1], float(w[-1]), prior)


def _sorted(rows: list[np.ndarray]) -> list[np.ndarray]:
    return sorted(rows, key=lambda x: x.tobytes())


def risk(z_p: np.ndarray, z_u: np.ndarray, n_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The corrected risk of logits of confirmed and of unlabelled texts (``n_u`` of each), and what is followed downhill for each of them."""
    s_p, s_u = 1 / (1 + np.exp(-np.clip(z_p, -40, 40))), 1 / (1 + np.exp(-np.clip(z_u, -40, 40)))
    n1, share = max(1, len(z_p)), n_u / max(1, n_u.sum())
    rest = float((share * np.logaddexp(0, z_u)).sum() - prior * np.logaddexp(0, z_p).sum() / n1)
    value = prior * float(np.logaddexp(0, -z_p).sum()) / n1 + max(0.0, rest)
    if rest >= 0:
        return value, prior / n1 * (s_p - 1) - prior / n1 * s_p, share * s_u
    return value, prior / n1 * s_p, -share * s_u  # back off: the estimate of the negatives' risk has gone below 0


def train_bag(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_u: np.ndarray, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias after STEPS steps of Adam on the corrected risk."""

    def flat(rows):
        return (np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    (row_p, col_p), (row_u, col_u) = flat(positive), flat(unlabelled)
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z_p = np.bincount(row_p, weights=w[col_p], minlength=len(positive)) + b
        z_u = np.bincount(row_u, weights=w[col_u], minlength=len(unlabelled)) + b
        _, g_p, g_u = risk(z_p, z_u, n_u, prior)
        gw = np.bincount(col_p, weights=g_p[row_p], minlength=width) + np.bincount(col_u, weights=g_u[row_u], minlength=width) + DECAY * w
        gb = g_p.sum() + g_u.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return w, float(b)


def score_batch(column: pa.Array, model: ToxicModel) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, doc, feature in _found(column, model.grams, model.mask):
        z = np.bincount(doc, weights=model.weights[feature], minlength=j - i) + model.bias
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def score(docs: DataFrame, model: ToxicModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on), for each row.

    A null text counts as empty.  Every text is read whole; its own label,
    language, source and key play no part.
    """
    shared = sent(docs.sparkSession, model)
    names = list(keep)

    def run(batches):
        own = shared()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = score_batch(part.column(at), own)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    source, at, kinds = with_text(docs, keep, text)
    return source.mapInArrow(tidy(run), f"{kinds}, score double, predicted int")
