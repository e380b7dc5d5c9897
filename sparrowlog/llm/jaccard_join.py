"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles.  All
sets are ordered alike: shingles that are rare in the corpus first.  Two sets
of Jaccard similarity t share at least L shingles among the first
``n - ceil(t n) + L`` of each.  A longer prefix costs more list entries but
demands more matches; every document picks the L that its own lists make
cheapest.

Frequencies are exact for all shingles whose hash lies in a region wide enough
for most prefixes; those come first, rare ones ahead, and the others follow by
hash.  Documents with the same set are one class, joined once.

Short lists are joined to pairs, which are counted and must match L times.  The
documents of a long list become one cluster, named after its first document, so
that large groups of near copies are never expanded into pairs.  A cluster is
dealt into blocks by what its sets hold, each with the first document's set
beside its own.  A block's whole sets are intersected in one kernel, which returns
a spanning forest of their links.  What a block has not linked with the first
document, usually little, meets every other block of its cluster; two documents
that are linked with it are in one component whether they link or not.  No list,
candidate or partner is dropped, so no component is lost.

Shingles that take a large share of all list entries are few.  They are found
first, and what concerns them is broadcast, so no task gets the entries of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import components, discard, release, tidy, tidy_group, written
from ._text import Powers, byte_codes, chunks, counted, distinct, shingles, space_table, span_hashes, utf8, word_bounds

#: Bytes of texts that a kernel hashes at a time.  That takes about 40 times as much memory, beside the batch.
PIECE = 1 << 18
#: Longest prefix extension that a document may choose.
MOST_MATCHES = 6
#: Lists of at most so many documents are joined to pairs; documents and shingles of a block of a cluster, on average.
SHORT, BLOCK, ITEMS = 4, 512, 1 << 18
#: What has more than one in so many of all list entries, or rows, is broadcast: at most so many rows.
HOT = 4096
#: Most bits, as a power of two, of the map of documents whose sets are read.
MAP_BITS = 28
#: How much wider than a prefix the region of exact frequencies is.
WIDTH = 1.7
#: Estimates behind a document's choice of L: what a verification costs in list entries for a shingle of the set,
#: and the part of candidates that each further match leaves.
VERIFY, LEFT = 1 / 64, 0.5


def _sets(column: pa.Array, k: int, powers: Powers) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles."""
    data, off = utf8(column)
    codes, space = byte_codes(lower=True), space_table()
    for i, j in chunks(off, PIECE):
        part, rel = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, doc = word_bounds(part, rel, space)
        made, at = shingles(span_hashes(part, s, e, codes, powers), doc, j - i, k)
        for d in range(j - i):
            yield distinct(made[at[d] : at[d + 1]])


def _profiles(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """A row for each document: its set's size and signature, and what of it may be in its prefix: ``n_region`` shingles of the region, then others, both by hash."""
    region = np.uint64(min(1.0, WIDTH * (100 - percent) / 100) * (2**64 - 1))

    def run(batches):
        powers = Powers(PIECE)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows, tokens = [], []
                for x in _sets(part.column(1), k, powers):
                    n = len(x)
                    inside = int(np.searchsorted(x, region, "right"))
                    long = min(n, n - (percent * n + 99) // 100 + MOST_MATCHES)
                    tokens.append(x[: max(inside, long)].view(np.int64))
                    sig = np.array([x.sum(), np.bitwise_xor.reduce(x * np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(29)))] if n else [0, 0], np.uint64).view(np.int64)
                    rows.append((n, int(sig[0]), int(sig[1]), inside))
                off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4)), pa.ListArray.from_arrays(off, pa.array(np.concatenate(tokens), pa.int64()))],
                    ["doc_id", "n", "sig1", "sig2", "n_region", "tokens"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, n long, sig1 long, sig2 long, n_region long, tokens array<long>")


def _set_table(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, k: int) -> DataFrame:
    """(d, items): whole sets of the documents in ``wanted`` (d), and of a few more.

    A bitmap of hashed ids tells in the scan which texts to read, so that texts are
    not shuffled.  Its size is bounded by MAP_BITS; where it fills up, more sets are
    made than wanted, which the next join drops.
    """
    spark = docs.sparkSession
    bits = 1 << min(MAP_BITS, max(20, (16 * wanted.count()).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = wanted.select((spot("d") + 1).alias("s"))  # bitmap functions count from 1
    marks = marks.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    found = np.zeros(bits // 8 + 4096, np.uint8)
    for r in marks.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        found[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(found)

    def run(batches):
        powers = Powers(PIECE)
        for b in batches:
            s = b.column(2).to_numpy()
            b = b.filter(pa.array((shared.value[s // 8] >> (s % 8).astype(np.uint8)) & 1 == 1))
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in _sets(part.column(1), k, powers)], pa.binary())], ["d", "items"])

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text")).where("d is not null")
    return rows.withColumn("s", spot("d")).mapInArrow(tidy(run), "d long, items binary")


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, asks: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of linked documents that connect all that links connect among ``sets``, and each one's component.

    One document is intersected with all others at a time, by the lists of its
    items.  A document that is in a largest component when its turn comes is put
    off.  Largest components change and tie, so of those put off, all outside of
    one component have their turn at the end: a link between two documents without
    a turn lies within that component.  ``asks`` marks the documents whose links
    count; those have their turn and no others.
    """
    size = np.array([len(x) for x in sets])
    items, at = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(at, kind="stable")
    lists, begin = doc[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(items)))])
    own = np.concatenate([[0], np.cumsum(size)])
    part = np.arange(len(sets))
    count = np.ones(len(sets), np.int64)
    out = []

    def turn(d: int) -> None:
        t = at[own[d] : own[d + 1]]
        n = begin[t + 1] - begin[t]
        ends = np.cumsum(n)
        met = lists[np.repeat(begin[t] - (ends - n), n) + np.arange(ends[-1])]
        both = np.bincount(met, minlength=len(sets))
        linked = np.flatnonzero((100 * both >= percent * (size[d] + size - both)) & (part != part[d]))
        for p, first in zip(*np.unique(part[linked], return_index=True)):
            out.append((int(ids[d]), int(ids[linked[first]])))
            count[part[d]] += count[p]
            count[p] = 0
            part[part == p] = part[d]

    late = []
    for d in range(len(sets)) if asks is None else ():
        if count[part[d]] == count.max() and count[part[d]] > 1:
            late.append(d)
        else:
            turn(d)
    if late:
        kept = late[int(np.argmax(np.bincount(part[late])[part[late]]))]  # of the component with most of them
        for d in late:
            if part[d] != part[kept]:
                turn(d)
    for d in np.flatnonzero(asks) if asks is not None else ():
        turn(int(d))
    return out, part


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(token, d, n, matches, layer): the entries of each document's longest prefix, with the least L whose prefix has them, and the document's choice of L."""
    by_doc = Window.partitionBy("d")
    rare_first = by_doc.orderBy("far", F.when(F.col("far"), 0).otherwise(F.col("df")), "token")
    e = shared.withColumn("far", F.col("at") >= F.col("n_region")).withColumn("need", F.expr(f"({percent} * n + 99) div 100"))
    # In the region a document's own shingles come first, then shared ones as ranked here; beyond it the place by hash holds.
    alone = F.col("n_region") - F.sum((~F.col("far")).cast("int")).over(by_doc)
    place = F.when(F.col("far"), F.col("at")).otherwise(alone + F.row_number().over(rare_first) - 1)
    e = e.withColumn("layer", F.greatest(F.lit(1), (place + 1 - (F.col("n") - F.col("need"))).cast("int"))).where(F.col("layer") <= F.least(F.lit(MOST_MATCHES), F.col("need")))
    cost = lambda m: F.lit(float(m)) + F.sum(F.when(F.col("layer") <= m, F.col("df") - 1).otherwise(0)).over(by_doc) * (1 + F.col("n") * VERIFY * LEFT ** (m - 1))
    # Plain columns: an array of structs for each entry would be millions of objects on the heap.
    e = e.withColumns({f"cost{m}": cost(m) if m == 1 else F.when(F.col("need") >= m, cost(m)).otherwise(float("inf")) for m in range(1, MOST_MATCHES + 1)})
    least = F.least(*(f"cost{m}" for m in range(1, MOST_MATCHES + 1)))
    best = F.coalesce(*(F.when(F.col(f"cost{m}") == least, m) for m in range(1, MOST_MATCHES + 1)))
    return e.withColumn("matches", best).select("token", "d", "n", "matches", "layer", "hot")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their
    sets of ``k``-word shingles (A-Z lower-cased; words split at ASCII white
    space).  A null or blank text has an empty set and links with nothing.
    Repeated rows each get a row, and rows of one id are one document when links are followed.  Extra columns are ignored.  A null id gets
    its own null component.
    """
    profiles = written(_profiles(docs, doc_id, text, k, percent), "profiles")
    # One representative of each class of equal sets: the row of the smallest id.
    named = profiles.where("n > 0 and doc_id is not null")
    classes = written(named.groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    # Ids are in the key, so that copies of one text do not meet in one task.
    chosen = classes.select("sig1", "sig2", F.col("rep").alias("doc_id"))
    reps = named.join(chosen, ["sig1", "sig2", "doc_id"], "left_semi").dropDuplicates(["sig1", "sig2", "doc_id"])
    reps = written(reps.select(F.col("doc_id").alias("d"), F.col("n").cast("int").alias("n"), F.col("n_region").cast("int").alias("n_region"), "tokens"), "representatives")
    release(profiles.sparkSession)
    lists = written(_prefixes(_shared(reps), percent), "lists")
    release(profiles.sparkSession)
    discard(reps)
    by_token = Window.partitionBy("token")
    counted = lists.where("not hot").withColumn("head", F.min("d").over(by_token)).withColumn("c", F.count("*").over(by_token))
    heads = lists.where("hot").groupBy("token").agg(F.min("d").alias("head"), F.count("*").alias("c")).orderBy("token").toPandas()  # at most HOT rows
    if len(heads):
        facts = docs.sparkSession.sparkContext.broadcast(tuple(heads[c].to_numpy(np.int64) for c in ("token", "head", "c")))

        def of_frequent(batches):
            tokens, head, c = facts.value
            for b in batches:
                token = b.column(0).to_numpy()
                at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                found = pa.array(tokens[at] == token)
                yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(found, pa.array(head[at]), None), pa.array(c[at])], [*b.schema.names, "head", "c"])

        kinds = ", ".join(f"{c} {t}" for c, t in counted.dtypes)
        counted = counted.unionByName(lists.select(counted.columns[:-2]).mapInArrow(tidy(of_frequent), kinds).where("head is not null"))
    long = counted.where(f"c > {SHORT}").select("head", "d", "n")
    short = counted.where(f"c between 2 and {SHORT}")
    x = short.select("token", *(F.col(c).alias(f"x_{c}") for c in ("d", "n", "matches", "layer")))
    y = short.select("token", *(F.col(c).alias(f"y_{c}") for c in ("d", "n", "layer")))
    # The later document asks, and fixes L.  A pair that also meets in a long list is in its cluster.
    pairs = (
        x.join(y, "token")
        .where(f"x_d > y_d and x_layer <= x_matches and y_layer <= x_matches and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)")
        .groupBy(F.col("y_d").alias("a"), F.col("x_d").alias("b")).agg(F.count("*").alias("c"), F.max("x_matches").alias("need"), F.max("y_n").alias("y_n"), F.max("x_n").alias("x_n"))
        .where("c >= need").select(F.col("a").alias("head"), F.inline(F.array(F.struct(F.col("a").alias("d"), F.col("y_n").alias("n")), F.struct(F.col("b").alias("d"), F.col("x_n").alias("n")))))
    )
    members = written(long.union(pairs).distinct(), "members")
    release(profiles.sparkSession)
    discard(lists)
    sets = written(_set_table(docs, doc_id, text, members.select("d").distinct(), k), "sets")
    links = _links(members, sets, percent)
    release(profiles.sparkSession)
    discard(members, sets)
    comp = written(components(links, "a", "b").withColumnRenamed("node", "rep"), "components")
    comp = classes.join(comp, "rep", "left").select("sig1", "sig2", "rows", F.coalesce("component", "rep").alias("component"))
    total = classes.agg(F.sum("rows")).first()[0] or 0
    frequent = F.broadcast(comp.where(F.col("rows") * HOT > total).select("sig1", "sig2", F.col("component").alias("found")))  # fewer than HOT rows
    rows = profiles.select("doc_id", "n", "sig1", "sig2").join(frequent, ["sig1", "sig2"], "left")
    rare = rows.where("found is null").drop("found").join(comp.where(F.col("rows") * HOT <= total).select("sig1", "sig2", F.col("component").alias("found")), ["sig1", "sig2"], "left")
    out = rows.where("found is not null").unionByName(rare)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found")).alias("component_id"))


def _shared(reps: DataFrame) -> DataFrame:
    """(token, d, n, n_region, at, df, hot): the entries of shingles that are in several of ``reps``.

    Shingles of one document alone link nothing; they only take up the beginnings
    of prefixes.  A shingle with more than two in HOT of all entries has more than
    one in HOT of them within tasks in each of which it has that share of the task's
    entries.  So counting in each task what is frequent there finds it, and at most
    HOT shingles reach the bound.
    """
    spark = reps.sparkSession

    def frequent(batches):
        parts, total = [], 0
        for b in batches:
            flat = b.column(0).flatten().to_numpy()
            total += len(flat)
            t, c = counted([flat])
            parts.append((t[c > 1], c[c > 1]))
            if sum(len(p[0]) for p in parts) > 1 << 22:
                parts = [_summed(parts)]
        t, c = _summed(parts)
        on = c * HOT >= total
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t[on], 0)), pa.array(np.append(c[on], 0)), pa.array(np.append(np.zeros(int(on.sum()), np.int64), total))], ["token", "c", "total"])

    found = reps.select("tokens").mapInArrow(tidy(frequent), "token long, c long, total long")
    found = written(found.groupBy("token").agg(F.sum("c").alias("c"), F.sum("total").alias("total")), "frequent")  # summed first: a file for each task would be tiny
    total = found.agg(F.sum("total")).first()[0] or 0
    tokens = np.sort(found.where(F.col("c") * HOT >= max(total, 1)).select("token").toPandas()["token"].to_numpy(np.int64))
    discard(found)
    shared = spark.sparkContext.broadcast(tokens)

    def count(batches):
        tokens = shared.value
        c = np.zeros(len(tokens), np.int64)
        for b in batches:
            flat = b.column(0).flatten().to_numpy()
            at = np.searchsorted(tokens, flat)
            at[at == len(tokens)] = 0
            c += np.bincount(at[tokens[at] == flat], minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(c)], ["token", "df"])

    entries = reps.select("d", "n", "n_region", F.posexplode("tokens").alias("at", "token"))
    rest = entries.withColumn("df", F.count("*").over(Window.partitionBy("token"))).withColumn("hot", F.lit(False))
    if not len(tokens):
        return rest.where("df > 1")
    own = reps.select("tokens").mapInArrow(tidy(count), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).orderBy("token").toPandas()
    facts = spark.sparkContext.broadcast((own["token"].to_numpy(np.int64), own["df"].to_numpy(np.int64)))

    def of_frequent(batches):
        tokens, df = facts.value
        for b in batches:
            flat, size = b.column(3).flatten().to_numpy(), np.diff(b.column(3).offsets.to_numpy())
            at = np.searchsorted(tokens, flat)
            at[at == len(tokens)] = 0
            hit = np.flatnonzero(tokens[at] == flat)
            row = np.repeat(np.arange(len(size)), size)[hit]
            place = hit - (np.cumsum(size) - size)[row]
            for lo in range(0, len(hit), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                own = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), b.column(2).take(own), pa.array(place[part].astype(np.int32)), pa.array(flat[hit[part]]), pa.array(df[at[hit[part]]])], ["d", "n", "n_region", "at", "token", "df"])

    frequent = reps.select("d", "n", "n_region", "tokens").mapInArrow(tidy(of_frequent), "d long, n int, n_region int, at int, token long, df long").withColumn("hot", F.lit(True))
    known = F.broadcast(spark.createDataFrame([(int(t),) for t in own["token"]], "token long"))  # at most HOT rows
    cold = entries.join(known, "token", "left_anti").withColumn("df", F.count("*").over(Window.partitionBy("token"))).withColumn("hot", F.lit(False))
    return cold.unionByName(frequent).where("df > 1")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return counted([p[0] for p in parts], [p[1] for p in parts])


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what links connect within each cluster of ``members`` (head, d, n)."""
    size = members.groupBy("head").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    size = size.select("head", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("items") / ITEMS)).cast("int").alias("blocks"))
    large = written(size.where("blocks > 1"), "large")
    few = large.count() <= 1_000_000
    of_head = F.broadcast(large) if few else large
    dealt = members.join(of_head, "head", "left").select("head", "d", F.expr("cast(pmod(xxhash64(d), coalesce(blocks, 1)) as int)").alias("block"), F.col("blocks").isNotNull().alias("many"))
    firsts = large.select("head", F.col("head").alias("d"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("many"))

    def within(t: pa.Table) -> pa.Table:
        ids, head = t["d"].to_numpy(), t["head"][0].as_py()
        found, part = forest(ids, [np.frombuffer(v.as_buffer(), np.uint64) for v in t["items"]], percent)
        out = ids[part != part[np.flatnonzero(ids == head)[0]]] if t["many"][0].as_py() else ids[:0]
        a, b = np.array([e[0] for e in found], np.int64), np.array([e[1] for e in found], np.int64)
        return pa.table({"a": pa.array(np.concatenate([a, out])), "b": pa.array(np.concatenate([b, out])), "head": pa.array([None] * len(a) + [head] * len(out), pa.int64())})

    first = written(dealt.union(firsts).distinct().join(sets, "d").groupBy("head", "block").applyInArrow(tidy_group(within), "a long, b long, head long"), "within")
    release(members.sparkSession)
    links = first.where("head is null").select("a", "b")
    left = first.where("head is not null").select("head", F.col("a").alias("d"))
    n_left = left.count()
    if n_left:
        left = members.join(left, ["head", "d"], "left_semi")
        asking = left.groupBy("head").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
        asking = written(asking.select("head", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("items") / ITEMS)).cast("int").alias("lots")).join(large, "head"), "asking")
        of_head = F.broadcast(asking) if few else asking
        asks = left.join(of_head, "head").select("head", "d", F.expr("cast(pmod(xxhash64(d, 1), lots) as int)").alias("lot"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("asks"))
        met = members.join(of_head, "head").select("head", "d", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), F.expr("cast(pmod(xxhash64(d), blocks) as int)").alias("block"), F.lit(False).alias("asks"))

        def across(t: pa.Table) -> pa.Table:
            asks, ids = t["asks"].to_numpy(zero_copy_only=False), t["d"].to_numpy()
            kept = asks | ~np.isin(ids, ids[asks])  # one that asks may also be met here
            rows = np.flatnonzero(kept)
            items = t["items"].combine_chunks()
            found, _ = forest(ids[rows], [np.frombuffer(items[int(i)].as_buffer(), np.uint64) for i in rows], percent, asks[rows]) if asks.any() else ([], None)
            return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})

        second = written(asks.select(met.columns).union(met).join(sets, "d").groupBy("head", "lot", "block").applyInArrow(tidy_group(across), "a long, b long"), "across")
        links = links.union(second)
    return links
