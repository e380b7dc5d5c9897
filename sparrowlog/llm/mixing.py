"""Mixing sources to target weights over packed blocks.

The words of a source's documents form one stream, cut into blocks of a fixed
length.  A recipe fixes how many words each source gives.  Output shards draw
how many blocks they take of each source from a multinomial over what is left;
the n-th block drawn from a source is block ``p(n)`` of its stream, where p is
a keyed permutation of block numbers, so a source is used up before any block
comes again.  Drawn blocks are joined with the stream by source and number.

The driver holds a few numbers for each source and shard.  Words are never
sent to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import tidy, written

#: Slots in a row before they are exploded.
RUN = 1 << 16
#: Ranges that a source's stream is summed in.  It fixes the order of the stream, so it is no setting.
RANGES = 4096


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: ``share`` of all sizes by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


class Permutation:
    """A keyed permutation of 0 .. n - 1: a Feistel network on the next power of four, walked until it falls below n."""

    ROUNDS = 4

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95 + 1) & (2**64 - 1) for r in range(self.ROUNDS)]

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        x = (x ^ np.uint64(self.keys[r])) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(64 - self.half)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, m = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & m
        for r in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            a, b = (b ^ self._round(a, r), a) if back else (b, a ^ self._round(b, r))
        return (a << h) | b

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        x = np.array(x, np.uint64)
        todo = np.ones(len(x), bool)
        while todo.any():
            x[todo] = self._once(x[todo], back)
            todo = x >= np.uint64(self.n)
        return x.astype(np.int64)


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int  # blocks drawn in all
    last_words: int  # words that the last of them gives


def recipe(totals: list[tuple], weights: tuple[float, ...], share: float, most: float, block: int, seed: int) -> list[Source]:
    """Sources by code point, null last, with their draws: exactly round(target) words each."""
    totals = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    want = targets([s for _, s in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    out = []
    for i, ((name, size), t) in enumerate(zip(totals, want, strict=True)):
        n = -(-size // block)
        if not size:
            out.append(Source(name, 0, t, 0, 0, 0))
            continue
        whole, rest = divmod(min(round(t), int(most * size)), size)
        # Where the short last block comes in the unfinished pass.
        at = int(Permutation(n, _key(seed, i, whole))(np.array([n - 1]), back=True)[0]) if rest else 0
        short = size - (n - 1) * block
        if rest == 0:
            slots, last = 0, (block if n > 1 else short)
            if whole:
                end = int(Permutation(n, _key(seed, i, whole - 1))(np.array([n - 1]))[0])
                last = short if end == n - 1 else block
        elif rest <= at * block:
            slots = -(-rest // block)
            last = rest - (slots - 1) * block
        elif rest <= at * block + short:
            slots, last = at + 1, rest - at * block
        else:
            more = rest - at * block - short
            slots = at + 1 + -(-more // block)
            last = more - (slots - at - 2) * block
        out.append(Source(name, size, t, n, whole * n + slots, last))
    return out


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + turn


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws from what is left of each source; all shards but the last have the same length."""
    left = np.array(slots, np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(slots)), np.int64)
    each = -(-int(left.sum()) // shards)
    for j in range(shards):
        need = min(each, int(left.sum()))
        if need == left.sum():
            out[j], left, need = left, np.zeros_like(left), 0
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[j] += got
            left -= got
            need -= int(got.sum())
    return out


def streams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, start, h): each row's words and where they begin in its source's stream.

    The order within a source is by a hash of the row, then by id.  Starts come from sums by
    (source, range), so that a source of any size is spread over many tasks.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("h"))
    d = d.withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(RANGES)).cast("int"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    within = Window.partitionBy("source", "part").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return d.select("doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start"), "h")


def drawn_blocks(spark, sources: list[Source], shards: int, block: int, seed: int) -> DataFrame:
    """(shard, slot, src, block, words, turn): every block of the mixture; ``words`` is its length or, at the very end of a source, less."""
    counts = shard_counts([s.slots for s in sources], shards, seed)
    begin = np.cumsum(counts, axis=0) - counts
    rows = [(int(j), int(i), int(begin[j, i]), int(counts[j, i])) for j in range(shards) for i in range(len(sources)) if counts[j, i]]
    facts = spark.sparkContext.broadcast([(s.blocks, s.slots, s.last_words, s.size) for s in sources])
    runs = spark.createDataFrame(rows, "shard int, src int, begin long, n long")
    runs = runs.select("shard", "src", "begin", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run")).repartition("shard", "src", "run")
    slots = runs.select("shard", "src", F.explode(F.expr(f"sequence(begin + run * {RUN}, begin + least(n, (run + 1) * {RUN}) - 1)")).alias("slot"))

    def place(batches):
        for b in batches:
            src, slot = b.column(1).to_numpy(), b.column(2).to_numpy()
            at, words, turn = np.zeros(len(src), np.int64), np.full(len(src), block, np.int64), np.zeros(len(src), np.int64)
            for i in np.unique(src):
                own = np.flatnonzero(src == i)
                n, m, last, size = facts.value[i]
                turn[own] = slot[own] // n
                for t in np.unique(turn[own]):
                    x = own[turn[own] == t]
                    at[x] = Permutation(n, _key(seed, int(i), int(t)))(slot[x] % n)
                words[own[at[own] == n - 1]] = size - (n - 1) * block
                words[own[slot[own] == m - 1]] = last
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(at), pa.array(words), pa.array(turn.astype(np.int32))], ["shard", "slot", "src", "block", "words", "turn"])

    return slots.mapInArrow(tidy(place), "shard int, slot long, src int, block long, words long, turn int")


@dataclass
class Mixture:
    rows: DataFrame  # doc_id, source, size, start, h, src
    spans: DataFrame  # shard, slot, turn, src, start, doc_id, h, first, until: words of a document that a drawn block holds
    sources: list[Source]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 512, shards: int = 64, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mixture:
    """The mixture of all rows of ``docs``.

    Each source gives exactly its rounded target; no word is taken more than
    ``most`` times.  Rows without words take no part.  Repeated rows are rows
    of their own.  Reruns draw the same.
    """
    spark = docs.sparkSession
    rows = written(streams(docs, doc_id, text, source), "streams")  # read several times below, and without texts
    totals = [(r[0], int(r[1] or 0)) for r in rows.groupBy("source").agg(F.sum("size")).collect()]  # a row for each source
    found = recipe(totals, weights, share, most, block, seed)
    names = spark.createDataFrame([(s.name, i) for i, s in enumerate(found)], "name string, src int")
    rows = rows.join(F.broadcast(names) if len(found) <= 10_000 else names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    pieces = rows.where("size > 0").select("src", "start", "size", "doc_id", "h", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    drawn = drawn_blocks(spark, found, shards, block, seed)
    spans = (
        pieces.join(drawn.hint("merge"), ["src", "block"])
        .withColumn("first", F.greatest(F.col("start"), F.col("block") * block) - F.col("start"))
        .withColumn("until", F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words")) - F.col("start"))
        .where("until > first")
        .select("shard", "slot", "turn", "src", "start", "doc_id", "h", "first", "until")
    )
    return Mixture(rows, spans, found)


def taken(m: Mixture) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of the documents."""
    per = m.spans.groupBy("src", "start").agg(F.sum(F.col("until") - F.col("first")).alias("taken"))
    spark = m.rows.sparkSession
    facts = spark.createDataFrame([(i, s.size, float(s.target)) for i, s in enumerate(m.sources)], "src int, source_size long, target double")
    full = m.rows.where("size > 0").join(per.hint("merge"), ["src", "start"], "left")
    none = m.rows.where("size = 0").withColumn("taken", F.lit(None).cast("long")).select(full.columns)
    out = full.union(none).join(F.broadcast(facts) if len(m.sources) <= 10_000 else facts, "src")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, m: Mixture, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as the mixture has them, with the columns of ``docs``.

    A row for each document and pass over its source; its text is what that
    pass took: the whole text as it was, or the taken runs of words joined by
    a space.
    """
    per = m.spans.groupBy("doc_id", "h", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "until"))).alias("runs"))
    names, at = docs.columns, docs.columns.index(text)
    # Columns go by place, so that none of ``docs`` can have the name of one made here.
    own = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("h", F.xxhash64(f"c{at}"))
    texts = own.dropDuplicates([f"c{names.index(doc_id)}", "h"])
    per = per.select(F.col("doc_id").alias("id"), F.col("h").alias("k"), "turn", "runs")
    joined = texts.join(per.hint("merge"), texts[f"c{names.index(doc_id)}"].eqNullSafe(per["id"]) & texts["h"].eqNullSafe(per["k"])).select(*(f"c{i}" for i in range(len(names))), "runs")
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def cut(batches):
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                for t, runs in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    merged: list[list[int]] = []
                    for r in runs:
                        if merged and merged[-1][1] == r["first"]:
                            merged[-1][1] = r["until"]
                        else:
                            merged.append([r["first"], r["until"]])
                    # Bytes are split at the same white space.
                    if merged == [[0, len(t.encode().split())]]:
                        out.append(t)
                        continue
                    spans = [m.span() for m in word.finditer(t)]
                    out.append(" ".join(t[spans[a][0] : spans[e - 1][1]] for a, e in merged))
                columns = [*part.columns[: len(names)]]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    return joined.mapInArrow(tidy(cut), kinds).toDF(*names)
