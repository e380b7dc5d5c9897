"""SimHash fingerprints and their search, in DataFrame functions only.

Every term of a text votes with its weight on each of 128 bits by its hash.
Votes are summed two bits to a long, 32 bits each, by a plain grouped sum that
combines before the shuffle.  A search cuts fingerprints into blocks and keeps
a table for each choice of blocks that must agree: two fingerprints within the
radius agree wholly in at least one choice, so nothing within it is missed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 128
#: Two lanes of 32 bits.
LANES = (1 << 32) + 1
#: Words of so many characters weigh a term of two of them twice.
LONG_WORD = 6


def _terms(text: str) -> str:
    """SQL for the terms of a text as longs: pairs of neighbouring words, the last word with none; the low bit tells the weight."""
    words = f"split(trim(BOTH ' \\t\\n\\f\\r' FROM lower({text})), '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+')"
    hashed = f"transform({words}, w -> (xxhash64(w) & -2L) | if(char_length(w) >= {LONG_WORD}, 1L, 0L))"
    return f"transform(array({hashed}), h -> zip_with(h, slice(h, 2, size(h)), (a, b) -> (xxhash64(a, b) & -2L) | (a & coalesce(b, 0L) & 1L)))[0]"


def text_key(text: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.col(text)), F.xxhash64(F.lit("second"), F.col(text))]


def fingerprints(texts: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, f1, f2): text_key of each distinct text and its fingerprint as two longs.

    Repeats of a text multiply all its votes, which leaves each majority as
    it is; so equal texts need not be removed first.  A text without words
    has one empty term.
    """
    k1, k2 = text_key(text)
    # Keys first: beside the explode they would be computed for every term.
    t = texts.select(k1.alias("k1"), k2.alias("k2"), F.expr(_terms(text)).alias("terms")).select("k1", "k2", F.explode("terms").alias("t"))
    t = t.select("k1", "k2", F.expr("1L + (t & 1L)").alias("w"), F.expr("xxhash64(t, 11)").alias("h1"), F.expr("xxhash64(t, 23)").alias("h2"))
    sums = [F.expr(f"sum(w * (shiftrightunsigned({h}, {i}) & {LANES}L))").alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(32)]
    votes = t.groupBy("k1", "k2").agg(F.sum("w").alias("w"), *sums)

    def folded(h: str) -> str:
        parts = [f"if(2 * shiftrightunsigned({h}_{i}, 32) > w, shiftleft(1L, {i + 32}), 0L) | if(2 * ({h}_{i} & 4294967295L) > w, shiftleft(1L, {i}), 0L)" for i in range(32)]
        return " | ".join(f"({p})" for p in parts)

    return votes.select("k1", "k2", F.expr(folded("h1")).alias("f1"), F.expr(folded("h2")).alias("f2"))


def hex_of(f1: str, f2: str) -> Column:
    return F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0"))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """1 for equal fingerprints, 0 for opposite ones, about a half for unrelated texts."""
    far = F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))
    return 1.0 - far.cast("double") / BITS


def _block(i: int, blocks: int, side: str) -> str:
    """SQL for block i of a fingerprint: a long of its bits."""
    lo, hi = BITS * i // blocks, BITS * (i + 1) // blocks
    parts = []
    for word, base in ((f"{side}f1", 0), (f"{side}f2", 64)):
        a, b = max(lo, base) - base, min(hi, base + 64) - base
        if a < b:
            mask = (1 << (b - a)) - 1
            parts.append(f"(shiftrightunsigned({word}, {a}) & {mask if mask < 2**63 else -1}L)")
    return parts[0] if len(parts) == 1 else f"(shiftleft({parts[0]}, 32) ^ {parts[1]})"


def within_radius(queries: DataFrame, base: DataFrame, radius: int = 3, agree: int = 2) -> DataFrame:
    """Pairs of fingerprints (q1, q2, f1, f2, distance) with distance <= radius.

    Both tables hold f1 and f2; repeats count once.  ``agree`` blocks of
    ``radius + agree`` agree in some table; more of them make the keys longer
    and chance meetings rarer, at the price of more tables.  A pair that meets
    in several tables is kept in the first only, and is compared within the
    join.
    """
    blocks = radius + agree
    tables = list(combinations(range(blocks), agree))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        keys = [F.struct(F.lit(n).alias("n"), F.expr(f"xxhash64({', '.join(_block(i, blocks, '') for i in t)})").alias("key")) for n, t in enumerate(tables)]
        return df.select("f1", "f2").distinct().select(F.col("f1").alias(f"{side}f1"), F.col("f2").alias(f"{side}f2"), F.inline(F.array(*keys)).alias("n", "key"))

    q, b = keyed(queries, "q_"), keyed(base, "b_")
    far = F.expr("bit_count(q_f1 ^ b_f1) + bit_count(q_f2 ^ b_f2)")
    same = [" AND ".join(f"{_block(i, blocks, 'q_')} = {_block(i, blocks, 'b_')}" for i in t) for t in tables]
    first = F.expr("CASE " + " ".join(f"WHEN {s} THEN {n}" for n, s in enumerate(same)) + " ELSE -1 END")
    met = q.join(b, (q["n"] == b["n"]) & (q["key"] == b["key"]) & (far <= radius) & (first == q["n"]))
    return met.select(F.col("q_f1").alias("q1"), F.col("q_f2").alias("q2"), F.col("b_f1").alias("f1"), F.col("b_f2").alias("f2"), far.alias("distance"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the row after it by ascending id; the last gets the first.

    Nulls of the id come first, ties go by text, a null text counts as empty.
    Ids are dealt into ranges of about equal size; the first row of a range
    also goes to the range before it, so each range is read by itself.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ids = d.select("doc_id").where("doc_id is not null")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    # How many cuts are at most the id, by halving: the array, filled up to a power of two, is halved in a fold.
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    filled = cuts + [None] * (2 * steps[0] - len(cuts)) if cuts else []
    ladder = ", ".join("null" if c is None else f"{c}L" for c in filled)
    bucket = F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (n, s) -> if(coalesce(array({ladder})[n + s - 1] <= doc_id, false), n + s, n))") if cuts else F.lit(0)
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket))
    # The first id of each range: at most ``parts`` rows.
    firsts = sorted((r[0], r[1]) for r in d.groupBy("bucket").agg(F.min("doc_id").alias("least")).collect())
    if not firsts:
        return d.select("doc_id", "text", F.lit("").alias("next_text"))
    order = [b for b, _ in firsts]
    ghosts = [(least, order[i - 1], i == 0) for i, (_, least) in enumerate(firsts)]
    g = F.broadcast(spark.createDataFrame(ghosts, "least long, before int, wraps boolean"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    rows = d.join(g, F.col("doc_id").eqNullSafe(F.col("least")), "left")
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("ghost"))))
    rows = rows.select("doc_id", "text", F.inline(places).alias("place", "ghost"))
    w = Window.partitionBy("place").orderBy((F.col("ghost") == 2).cast("int"), F.col("doc_id").asc_nulls_first(), "text")
    # A ghost of the range's own ids cannot be: it belongs to the next range, or comes last of all.
    return rows.withColumn("next_text", F.lead("text").over(w)).where("ghost = 0").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """with_next's rows, their last half replaced by the next text's beginning."""
    half = "(char_length(text) div 2)"
    return docs.withColumn("edited", F.expr(f"concat(substring(text, 1, int(char_length(text) - {half})), substring(next_text, 1, int({half})))"))
