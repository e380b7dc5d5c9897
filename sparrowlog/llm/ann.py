"""Nearest neighbours from low-dimensional stable projections, indexed by kd-trees.

Vectors are projected on a few Gaussian (2-stable) directions.  A kd-tree over
the projections of a bounded sample cuts their space into cells; every vector is
in one cell, and a cell that holds many is dealt into blocks.  A query searches
its own block first.  A vector x that beats the k-th best score s there has a
squared distance of |q|^2 + |x|^2 - 2 s at most from the query q.  Its projected
squared distance is the true one times a chi-square variable, so with known
certainty it is no more than this times a quantile.  Only the cells that may
hold such vectors, by their box and their greatest length, get the query.

Within a block a kd-tree of its own gives the query's projected neighbours leaf
by leaf.  Those that pass the test by their own length are verified on all their
coordinates, which raises s; the search stops once no leaf passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, sent, tidy, tidy_group, written

#: Vectors of a block and queries that are sent to it together, on average; vectors of a leaf.
BLOCK, QUERIES, LEAF = 8192, 4096, 64
#: Vectors that the tree of cells is made from, at most about.
SAMPLE = 1 << 16
PROJECTIONS = 16
#: Chance that a vector as near as the k-th best lies within the ball.
CERTAINTY = 0.88


def chi2_quantile(p: float, m: int) -> float:
    """The p-quantile of a chi-square variable with an even number m of degrees, by bisection of its closed form."""
    low, high = 0.0, 50.0 + 20.0 * m

    def cdf(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf of a kd-tree that halves the widest dimension at its median."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        x = points[rows]
        d = int(np.argmax(x.max(0) - x.min(0)))
        half = len(rows) // 2
        order = np.argpartition(x[:, d], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


@dataclass
class Cells:
    """A kd-tree of cells.  Node i asks whether coordinate ``dim[i]`` is at least ``cut[i]``; ``child`` is a node, or a cell as -1 - cell; boxes of the cells."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def find(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if len(self.dim) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = self.child[n, (points[inner, self.dim[n]] >= self.cut[n]).astype(np.int64)]
        return -1 - at

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            x = points[:, d : d + 1]
            out += np.maximum(np.maximum(self.low[None, :, d] - x, x - self.high[None, :, d]), 0) ** 2
        return out


def cells_of(sample: np.ndarray, dims: int, cells: int) -> Cells:
    """A tree of about ``cells`` cells with as many points of the sample in each; where points are equal, fewer."""
    dim, cut, child, low, high = [], [], [], [], []
    most = max(1, len(sample) // max(cells, 1)) if cells > 1 else len(sample)
    todo = [(np.arange(len(sample)), np.full(dims, -np.inf), np.full(dims, np.inf), -1, 0)]
    while todo:
        rows, lo, hi, parent, side = todo.pop()
        x = sample[rows]
        wide = x.max(0) - x.min(0) if len(rows) else np.zeros(dims)
        d = int(np.argmax(wide))
        value = float(np.median(x[:, d])) if len(rows) else 0.0
        right = x[:, d] >= value if len(rows) else np.zeros(0, bool)
        if right.all() and len(rows) and wide[d] > 0:  # the median is the least value
            value = float(x[x[:, d] > value, d].min())
            right = x[:, d] >= value
        if len(rows) <= 1.5 * most or wide[d] <= 0:
            node = -1 - len(low)
            low.append(lo)
            high.append(hi)
        else:
            node = len(dim)
            dim.append(d)
            cut.append(value)
            child.append([0, 0])
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[d] = right_lo[d] = value
            todo += [(rows[~right], lo, left_hi, node, 0), (rows[right], right_lo, hi, node, 1)]
        if parent >= 0:
            child[parent][side] = node
    return Cells(np.array(dim, np.int64), np.array(cut), np.array(child, np.int64).reshape(-1, 2), np.array(low), np.array(high))


def basis_of(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, PROJECTIONS))


def ball(q2: np.ndarray, x2: np.ndarray, kth: np.ndarray, far: float) -> np.ndarray:
    """Greatest projected squared distance at which vectors of squared length ``x2`` count; a little more for rounding."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(kth), np.inf, far * np.maximum(q2 + x2 - 2 * kth, 0) + 1e-9 * (q2 + x2))


def search_block(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, basis: np.ndarray, known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(ids, scores, vectors verified) of each query's best in a block, at most k, best first; all in double precision.

    ``known``: the score of a k-th best from elsewhere, which bounds the ball from the beginning.
    """
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    kept = np.arange(len(ids)) - start <= k
    ids, vectors = ids[kept], vectors[kept]
    low = vectors @ basis
    leaves = kd_leaves(low)
    order = np.concatenate(leaves)  # leaf by leaf
    ids, vectors, low = ids[order], np.ascontiguousarray(vectors[order]), low[order]
    ends = np.cumsum([len(r) for r in leaves])
    begins = ends - np.array([len(r) for r in leaves])
    of_leaf = begins[:, None] + np.arange(LEAF)
    of_leaf = np.where(of_leaf < ends[:, None], of_leaf, -1)
    x2 = (vectors**2).sum(1)
    boxes = Cells(np.zeros(0), np.zeros(0), np.zeros((0, 2)), np.minimum.reduceat(low, begins), np.maximum.reduceat(low, begins))
    leaf_x2 = np.maximum.reduceat(x2, begins)
    n, far = len(ids), chi2_quantile(CERTAINTY, PROJECTIONS)
    lengths = (low**2).sum(1)
    by_id = np.argsort(ids, kind="stable")
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    step = max(1, min(256, (1 << 22) // max(n, 1)))
    for lo in range(0, len(queries), step):
        q, own = queries[lo : lo + step], q_ids[lo : lo + step]
        qp, q2 = q @ basis, (q**2).sum(1)[:, None]
        gap = boxes.gaps(qp)
        near = (gap - far * leaf_x2).argsort(1, kind="stable")  # the leaf that passes longest comes first
        gap, near_x2 = np.take_along_axis(gap, near, 1), leaf_x2[near]
        apart = (qp**2).sum(1)[:, None] + lengths - 2 * (qp @ low.T)
        score = np.full((len(q), n), -np.inf)
        a, b = np.searchsorted(ids[by_id], own, "left"), np.searchsorted(ids[by_id], own, "right")
        for i in np.flatnonzero(b > a):
            apart[i, by_id[a[i] : b[i]]] = np.inf  # its own rows are no candidates
        kth = np.full((len(q), 1), -np.inf) if known is None else known[lo : lo + step].reshape(-1, 1).copy()
        top = np.full((len(q), k), -np.inf)  # the least of the best k stands first
        at, width = 0, 4
        while at < len(leaves):
            # Later leaves pass only if the next one does.
            live = gap[:, at] <= ball(q2[:, 0], near_x2[:, at], kth[:, 0], far)
            if not live.any():
                break
            rows = of_leaf[near[live, at : at + width]].reshape(int(live.sum()), -1)
            dist = np.where(rows >= 0, np.take_along_axis(apart[live], np.maximum(rows, 0), 1), np.inf)
            passes = (dist <= ball(q2[live], x2[rows], kth[live], far)) & (dist < np.inf)
            new = np.full(rows.shape, -np.inf)
            for r, i in enumerate(np.flatnonzero(live)):
                c = np.flatnonzero(passes[r])
                new[r, c] = score[i, rows[r, c]] = vectors[rows[r, c]] @ q[i]
            if k:
                top[live] = np.partition(np.concatenate([top[live], new], axis=1), -k, axis=1)[:, -k:]
                kth[live, 0] = np.maximum(kth[live, 0], top[live, 0])
            at, width = at + width, 2 * width
        for i in range(len(q)):
            found = np.flatnonzero(score[i] > -np.inf)
            n_found = len(found)
            if n_found > k:  # those that rounding may bring among the best
                last = np.partition(score[i, found], n_found - k)[n_found - k]
                found = found[score[i, found] >= last - 1e-12 * math.sqrt(q2[i, 0] * x2.max())]
            exact = (vectors[found] * q[i]).sum(1)
            best = np.lexsort((ids[found], -exact))[:k]
            out.append((ids[found][best], exact[best], n_found))
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding", seed: int = 5, block: int = BLOCK, lot: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k vectors of largest inner product for each query, and how many were verified for it.

    Queries are the rows whose key is divisible by ``every``; candidates are all
    rows but those with the query's own key.  Ties go to the smaller key.  A
    null key, and a vector that is null, empty, zero or holds a null or a
    non-finite component, takes no part; nor does one of another length than
    most have (of two equally frequent lengths the smaller counts).  Repeated
    rows are candidates each; of queries with one key the first by vector asks.
    """
    spark = bound_batches(vectors.sparkSession)
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    v = v.withColumn("dim", F.size("v"))
    facts = v.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    kind = "query_id long, rank int, vec_id long, score double, verified long"
    if facts is None:
        return spark.createDataFrame([], kind)
    dim, n = facts["dim"], facts["n"]
    v = v.where(F.col("dim") == dim).select("id", "v")
    basis = basis_of(dim, seed)

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)

    def project(batches):
        for b in batches:
            low = matrix(b.column(0)) @ basis
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(low.ravel()), PROJECTIONS).cast(pa.list_(pa.float64()))], ["low"])

    scale = 1 << 30
    some = v.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(scale)) < min(scale, scale * SAMPLE // n + 1)).select("v")
    wanted = -(-n // block)
    sample = some.mapInArrow(tidy(project), "low array<double>").toPandas()["low"] if wanted > 1 else []  # about SAMPLE rows at most
    sample = np.array(list(sample), np.float64).reshape(-1, PROJECTIONS)
    sample = sample[np.lexsort(sample.T)]
    cells = cells_of(sample, PROJECTIONS, min(wanted, max(1, len(sample) // 4)))
    tree = sent(spark, cells)

    def place(batches):
        own = tree()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.find(matrix(b.column(1)) @ basis).astype(np.int32))], ["id", "v", "cell"])

    placed = v.mapInArrow(tidy(place), "id long, v array<double>, cell int")
    held, cell_x2 = np.zeros(len(cells.low), np.int64), np.zeros(len(cells.low))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("x2")).collect():  # a row a cell
        held[r["cell"]], cell_x2[r["cell"]] = r["n"], r["x2"]
    # Blocks of a cell are numbered one after another.
    blocks = np.maximum(1, -(-held // (2 * block)))
    first = np.cumsum(blocks) - blocks
    cell_facts = spark.createDataFrame([(i, int(first[i]), int(blocks[i])) for i in range(len(held))], "cell int, first int, blocks int")
    placed = placed.join(F.broadcast(cell_facts), "cell")  # at most SAMPLE rows
    placed = placed.select((F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).cast("int").alias("block"), "id", "v")
    found_kind = "query_id long, v array<double>, block int, kth double, verified long, best array<struct<vec_id: long, score: double>>"
    best_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))

    def rows_of(block_id: int, q_ids, queries, found) -> pa.Table:
        last = [float(s[k - 1]) if len(s) >= k else -math.inf for _, s, _ in found]
        return pa.table({
            "query_id": pa.array(q_ids, pa.int64()), "v": pa.array([x.tolist() for x in queries], pa.list_(pa.float64())), "block": pa.array([block_id] * len(found), pa.int32()), "kth": pa.array(last, pa.float64()),
            "verified": pa.array([c for _, _, c in found], pa.int64()), "best": pa.array([[{"vec_id": int(a), "score": float(s)} for a, s in zip(i, x)] for i, x, _ in found], best_type),
        })

    def home(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), matrix(t["v"])
        order = np.lexsort((*x.T[::-1], ids))
        q = order[ids[order] % every == 0]
        q = q[np.append(True, ids[q][1:] != ids[q][:-1])] if len(q) else q
        return rows_of(t["block"][0].as_py(), ids[q], x[q], search_block(ids, x, ids[q], x[q], k, basis))

    at_home = placed.groupBy("block").applyInArrow(tidy_group(home), found_kind)
    # Rows of one key are in one cell only if equal: the first by vector asks.
    one = Window.partitionBy("query_id").orderBy("v")
    at_home = written(at_home.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r"), "home")
    owner = np.repeat(np.arange(len(blocks)), blocks)
    far = chi2_quantile(CERTAINTY, PROJECTIONS)

    def route(batches):
        own = tree()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                q, kth = matrix(part.column(1)), part.column(3).to_numpy()
                passes = own.gaps(q @ basis) <= ball((q**2).sum(1)[:, None], cell_x2, kth[:, None], far)
                i, c = np.nonzero(passes[:, owner])
                away = c != part.column(2).to_numpy()[i]
                i, c = pa.array(i[away]), pa.array(c[away].astype(np.int32))
                yield pa.RecordBatch.from_arrays([c, part.column(0).take(i), part.column(1).take(i), part.column(3).take(i)], ["block", "id", "v", "kth"])

    asked = at_home.mapInArrow(tidy(route), "block int, id long, v array<double>, kth double")
    lots = {r["block"]: -(-r["count"] // lot) for r in asked.groupBy("block").count().collect()} if len(owner) > 1 else {}  # a row a block
    merged = at_home
    if lots:
        per_block = F.broadcast(spark.createDataFrame([(b, m) for b, m in lots.items()], "block int, lots int"))
        asked = asked.join(per_block, "block").select("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("lots")).cast("int").alias("lot"), "id", "v", "kth")
        # A block is copied only where more queries come to it than a task takes.
        base = placed.join(per_block, "block").select("block", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), "id", "v", F.lit(None).cast("double").alias("kth"))

        def visit(t: pa.Table) -> pa.Table:
            asks = ~np.asarray(t["kth"].is_null())
            ids, x = t["id"].to_numpy(), matrix(t["v"])
            q = np.flatnonzero(asks)
            found = search_block(ids[~asks], x[~asks], ids[q], x[q], k, basis, t["kth"].to_numpy(zero_copy_only=False)[q]) if len(q) else []
            return rows_of(t["block"][0].as_py(), ids[q], x[q], found)

        merged = at_home.drop("v").union(base.union(asked).groupBy("block", "lot").applyInArrow(tidy_group(visit), found_kind).drop("v"))
        merged = written(merged, "found")  # at most k results a query and block
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    flat = merged.select("query_id", F.inline("best"))
    best = flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(merged.groupBy("query_id").agg(F.sum("verified").alias("verified")), "query_id").select("query_id", "rank", "vec_id", "score", "verified")
