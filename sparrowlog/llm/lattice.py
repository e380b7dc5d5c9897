"""The lattice of SentencePiece as Spark relations.

Distinct words explode into their substrings of bounded length, those are
equi-joined with the piece table, edges are grouped by word, and a higher-order
``aggregate`` folds each word's edges: by Viterbi's recursion for unigram tables,
and for BPE tables by applying the cheapest merge of two neighbours until none is
left.  Words then go back to their places in the texts.

Results are those of ``piece_codec``, which builds the same relations within an
Arrow batch and is what the queries use: here every word of every text is shuffled
twice, and a fold looks at a word's pieces again for each merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .piece_codec import SPACE, PieceTable

#: More than any piece is long.
WIDE = 1 << 20


def spans_spaces(model: PieceTable) -> bool:
    """Whether a piece holds a space after another character, so that words cannot be cut before spaces."""
    return any(chr(SPACE) in p.lstrip(chr(SPACE)) for p in model.pieces)


def edges_of(words: DataFrame, model: PieceTable) -> DataFrame:
    """(word, n, edges): for each word its length and the pieces in it, as (a, b, rank, score) from character a to b."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, r, float(s)) for r, (p, s) in enumerate(zip(model.pieces, model.scores))], "piece string, rank int, score double")
    longest = max(map(len, model.pieces), default=1)
    w = words.select("word", F.char_length("word").alias("n"))
    parts = w.select("word", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("a"))
    parts = parts.select("word", "n", "a", F.explode(F.expr(f"sequence(1, least({longest}, n - a))")).alias("k"))
    parts = parts.withColumn("piece", F.expr("substring(word, a + 1, k)"))
    # As many rows as the vocabulary has.  A character without a piece leaves its word whole, so the join is an outer one.
    met = parts.join(F.broadcast(table), "piece", "left").where("rank is not null or k = 1")
    edge = F.struct("a", F.expr("a + k").alias("b"), "rank", "score")
    return met.groupBy("word", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _bpe() -> str:
    """SQL: the cuts of a word after all merges."""
    ranks = f"map_from_entries(transform(filter(edges, e -> e.rank is not null), e -> struct(cast(e.a as bigint) * {WIDE} + e.b, e.rank)))"
    best = f"array_min(filter(transform(sequence(0, size(c) - 3), j -> struct(element_at(m, cast(c[j] as bigint) * {WIDE} + c[j + 2]) as r, j as j)), x -> x.r is not null))"
    step = f"if(size(c) < 3, c, transform(array({best}), x -> if(x is null, c, concat(slice(c, 1, x.j + 1), slice(c, x.j + 3, size(c)))))[0])"
    return f"transform(array({ranks}), m -> aggregate(sequence(1, n), sequence(0, n), (c, i) -> {step}))[0]"


def _viterbi(low: float) -> str:
    """SQL: the cuts of a word's best path; a character without a piece costs ``low``."""
    # s: best score of each prefix and where its last piece begins.  Of equal scores the shorter last piece counts.
    into = f"transform(filter(edges, e -> e.b = i), e -> struct(s[e.a].score + coalesce(e.score, {low}D) as score, e.a as a))"
    best = f"aggregate(sequence(1, n), array(named_struct('score', 0D, 'a', 0)), (s, i) -> concat(s, array(array_max({into}))))"
    return f"transform(array({best}), s -> reverse(aggregate(sequence(1, n), array(n), (c, i) -> if(c[size(c) - 1] = 0, c, concat(c, array(s[c[size(c) - 1]].a))))))[0]"


def pieces_of(words: DataFrame, model: PieceTable) -> DataFrame:
    """(word, ids): the ids of each word's pieces, a row for each of ``words`` (word: distinct, not empty, spaces as the piece sign)."""
    spark = words.sparkSession
    low = float(model.scores.min() if len(model.scores) else 0.0) - 10
    cut = edges_of(words, model).withColumn("cuts", F.expr(_bpe() if model.kind == "bpe" else _viterbi(low)))
    found = cut.select("word", F.expr("transform(sequence(0, size(cuts) - 2), j -> struct(j as j, substring(word, cuts[j] + 1, cuts[j + 1] - cuts[j]) as piece))").alias("p"))
    ids = F.broadcast(spark.createDataFrame([(p, int(i)) for p, i in zip(model.pieces, model.ids)], "piece string, id int"))
    byte = [int(x) for x in model.byte_ids]
    unknown = f"array({model.unknown_id})"
    known = ", ".join(map(str, byte))
    raw = "sequence(0, octet_length(piece) - 1)"
    own = f"transform({raw}, k -> array({known})[int(conv(substring(hex(encode(piece, 'UTF-8')), 2 * k + 1, 2), 16, 10))])"
    fallback = f"if(exists({own}, x -> x < 0), {unknown}, {own})"
    flat = found.select("word", F.inline("p")).join(ids, "piece", "left").withColumn("own", F.expr(f"if(id is null, {fallback}, array(id))"))
    return flat.groupBy("word").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("j", "own"))), lambda x: x["own"])).alias("ids"))


def encode_relations(docs: DataFrame, model: PieceTable, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for each row, by relations only.

    A null or empty text has an empty array; repeated rows are rows of their own.
    """
    if spans_spaces(model):
        raise ValueError("a piece holds a space within: words cannot be cut before spaces")
    sign = chr(SPACE)
    marked = F.concat(F.lit(sign), F.translate(F.col(text), " ", sign)) if model.dummy_space else F.translate(F.col(text), " ", sign)
    # A row's own number: rows may repeat.
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(f"{sign}*[^{sign}]+|{sign}+"), F.lit(0))).alias("words")), "rows")
    places = rows.select("row", F.posexplode("words").alias("at", "word"))
    found = written(pieces_of(places.select("word").distinct(), model), "pieces")
    ids = places.join(found, "word").groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("row", F.col("key").alias(key)).join(ids, "row", "left").select(key, F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
