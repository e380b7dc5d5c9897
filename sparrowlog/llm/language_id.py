"""Language identification by bit-sliced Bloom filters of letter n-grams.

One Bloom filter for each learned language, stored as bit slices: slot i of
the table holds a bit for each language.  Anding the slots of an n-gram gives
every language whose filter contains it, in a few reads however many languages
there are.  A text's bits are counted for each language; as a share f of a
filter's answers is false, a count c of n becomes (c - n f) / (1 - f), and the
language with the largest corrected count is predicted.  A short text of whose
n-grams none is known is decided by shorter ones, which have filters of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sent, tidy, with_text, written
from ._text import byte_grams, chunks, counted, letter_stream, letter_table, mix, utf8

#: Bytes of an n-gram, slots for each n-gram, and slots of a filter for each n-gram in it, about.
GRAM, HASHES, ROOM = 5, 2, 4
#: Bytes of shorter n-grams, how much more one of a byte more counts, and the n-grams from which on a text does without them.
SHORT, WEIGHT, FEW = (2, 3, 4), 4, 20
#: Most slots of a filter, as a power of two.
WIDE = 24
#: An n-gram goes into a language's filter if it is there at least this share as frequent as in its best language.
SHARE = 0.25


@dataclass
class LanguageFilters:
    """``langs`` in ascending order; ``slots[plane]``: bit b stands for language 64 plane + b; ``false_rate`` by language; the same for shorter n-grams."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    short_slots: np.ndarray
    short_rate: np.ndarray


def _slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(g)
    return [((h >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts_a_language: int = 4000) -> LanguageFilters:
    """Filters from labelled texts.

    Rows without text or language are left out.  ``texts_a_language`` bounds the
    labelled texts that are learned from: of a language with more, that share is
    taken by the hash of their key, so about so many (of rows with a null key all or none).  All that the driver
    receives is bounded by these texts.  Filters grow with their n-grams, of
    which none is dropped but those seen only once.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    each = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row for each language
    langs = [r["lang"] for r in each]
    if not langs:
        return LanguageFilters([], *_filters(None, 0, 0), *_filters(None, 0, 0))
    scale = 1 << 30
    shares = spark.createDataFrame([(i, x["lang"], min(scale, scale * texts_a_language // x["n"] + 1)) for i, x in enumerate(each)], "index int, lang string, share long")
    # As few rows as languages; their number is known here.
    known = F.broadcast(shares) if len(langs) <= 10_000 else shares
    texts = rows.join(known, "lang").where(F.pmod(F.xxhash64("key"), F.lit(scale)) < F.col("share")).select("index", "text")

    def count(batches):
        table = letter_table()
        held: dict[int, list] = {}
        for b in batches:
            data, off = utf8(b.column(1))
            own = b.column(0).to_numpy()
            for i, j in chunks(off):
                x, bounds = letter_stream(data[off[i] : off[j]], off[i : j + 1] - off[i], table)
                for size in (*SHORT, GRAM):
                    g, doc = byte_grams(x, bounds, size)
                    of = own[i:j][doc]
                    for k in np.unique(own[i:j]):
                        held.setdefault(int(k), []).append(counted([g[of == k]]))
        for k, parts in held.items():
            grams, n = counted([p[0] for p in parts], [p[1] for p in parts])
            for lo in range(0, len(grams), 1 << 16):
                m = len(grams[lo : lo + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k, np.int32)), pa.array(grams[lo : lo + m].view(np.int64)), pa.array(n[lo : lo + m].astype(np.int64))], ["index", "gram", "n"])

    counts = texts.mapInArrow(tidy(count), "index int, gram long, n long").groupBy("index", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("long", F.col("gram") >= GRAM << 8 * GRAM), "grams")
    totals = counts.groupBy("index", "long").agg(F.sum("n").alias("total"))
    totals = F.broadcast(totals) if len(langs) <= 10_000 else totals  # two rows a language
    share = counts.where("n >= 2").join(totals, ["index", "long"]).withColumn("p", F.col("n") / F.col("total"))
    # One entry a language in each list.
    best = share.groupBy("gram", "long").agg(F.max("p").alias("best"), F.collect_list(F.struct("index", "p")).alias("each"))
    member = best.select("gram", "long", F.explode(F.expr(f"filter(each, e -> e.p >= {SHARE} * best)")).alias("e")).select("gram", "long", F.expr("e.index div 64").alias("plane"), F.expr("shiftleft(1L, e.index % 64)").alias("bit"))
    member = written(member.groupBy("gram", "long", "plane").agg(F.bit_or("bit").alias("bits")), "members")
    return LanguageFilters(langs, *_filters(member.where("long"), len(langs), WIDE), *_filters(member.where("not long"), len(langs), WIDE))


def _filters(member: DataFrame | None, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and false rates of ``k`` filters of the n-grams in ``member`` (gram, plane, bits); at most 2 ** ``most`` slots, beyond which they are false more often."""
    planes = max(1, (k + 63) // 64)
    wide = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(k, 64) <= n)
    n = member.count() if member is not None else 0
    bits = min(most, max(10, (ROOM * n).bit_length()))
    slots = np.zeros((planes, 1 << bits), wide)
    if n:

        def place(batches):
            for b in batches:
                for at in _slots(b.column(0).to_numpy().view(np.uint64), bits):
                    yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1), b.column(2)], ["slot", "plane", "bits"])

        made = member.select("gram", F.col("plane").cast("int"), "bits").mapInArrow(tidy(place), "slot long, plane int, bits long").groupBy("slot", "plane").agg(F.bit_or("bits").alias("bits"))
        got = made.toPandas()  # at most a row for each slot and plane
        slots[got["plane"].to_numpy(), got["slot"].to_numpy()] = got["bits"].to_numpy(np.int64).view(np.uint64).astype(wide)
    rate = np.array([float((slots[i // 64] >> wide(i % 64) & wide(1)).mean()) ** HASHES for i in range(k)])
    return slots, rate


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _hits(x: np.ndarray, bounds: np.ndarray, size: int, slots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each text, and of these what each of ``k`` filters contains."""
    n = len(bounds) - 1
    g, doc = byte_grams(x, bounds, size)
    at, hits = _slots(g, slots.shape[1].bit_length() - 1), np.zeros((n, k))
    for plane in range(len(slots)):
        found = slots[plane][at[0]]
        for s in at[1:]:
            found &= slots[plane][s]
        for b in range(min(64, k - 64 * plane)):
            hits[:, 64 * plane + b] = np.bincount(doc[(found >> found.dtype.type(b)) & found.dtype.type(1) != 0], minlength=n)
    return np.bincount(doc, minlength=n), hits


def _share(hits: np.ndarray, total: np.ndarray, rate: np.ndarray) -> np.ndarray:
    f = np.minimum(rate, 0.999)
    return np.clip((hits - total[:, None] * f) / ((1 - f) * np.maximum(total, 1)[:, None]), 0, 1)


def predict_batch(column: pa.Array, model: LanguageFilters) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and how many n-grams it has."""
    data, off = utf8(column)
    table = letter_table()
    n, k = len(off) - 1, len(model.langs)
    hits, total, ink = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros(n, bool)
    for i, j in chunks(off):
        x, bounds = letter_stream(data[off[i] : off[j]], off[i : j + 1] - off[i], table)
        ascii_letter = np.concatenate([[0], np.cumsum((x >= 97) & (x <= 122))])
        ink[i:j] = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
        total[i:j], hits[i:j] = _hits(x, bounds, GRAM, model.slots, k)
    for r in np.flatnonzero(~ink):
        ink[r] = off[r + 1] > off[r] and has_letter(data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"))
    langs, scores = ["und"] * n, np.zeros(n)
    if k:
        share = _share(hits, total, model.false_rate)
        for r in np.flatnonzero(ink & (total < FEW) & (share.max(1) == 0)):
            x, bounds = letter_stream(data[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]), table)
            found = [(WEIGHT ** (size - SHORT[0]), *_hits(x, bounds, size, model.short_slots, k)) for size in SHORT]
            share[r] = _share(sum(w * h for w, _, h in found), sum(w * t for w, t, _ in found), model.short_rate)[0]
        best = share.argmax(1)
        for r in np.flatnonzero(ink):
            langs[r], scores[r] = model.langs[best[r]], share[r, best[r]]
    return langs, scores, total


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text", keep: tuple[str, ...] = ("doc_id",), grams: bool = False) -> DataFrame:
    """``keep``'s columns with ``lang_pred`` and ``score``, and on demand ``n_grams``, for each row.

    A text that is null or has no letter is ``und`` with score 0.  A text
    of fewer than FEW n-grams, none of them known, is decided and scored by shorter
    ones; if none of these is known either, it gets the first language with score 0.  Ties go to
    the first language.  Any length of text is read whole.
    """
    shared = sent(docs.sparkSession, model)

    def run(batches):
        own = shared()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                langs, scores, total = predict_batch(part.column(at), own)
                made = [pa.array(langs, pa.string()), pa.array(scores), *([pa.array(total, pa.int64())] if grams else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *made], [*names, *extra])

    source, at, kinds = with_text(docs, keep, text)
    names = list(keep)
    extra = ["lang_pred", "score", *(["n_grams"] if grams else [])]
    return source.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double" + (", n_grams long" if grams else ""))
