"""Nearest neighbours by low-dimensional stable projections and a kd-tree.

The largest inner product becomes the smallest Euclidean distance by one more
coordinate, sqrt(max norm^2 - norm^2), and vectors are projected by a Gaussian
(2-stable) matrix into ``PROJECTED`` dimensions. There, the ratio of the squared
projected and original distances is chi-squared with that many degrees of
freedom. So neighbours taken in the order of their projected distance are
verified on the original vectors until the next projected distance r satisfies
P(chi2 <= r^2 / d_k^2) >= ``CONFIDENCE``, with d_k the k-th smallest distance so
far: a nearer vector would have shown up by then with that probability.

The kd-tree has two levels. Its top splits the projected space into cells and is
fitted on a bounded sample (``SAMPLE`` vectors); every vector is indexed in its
cell, large cells are dealt into blocks. Each block has a tree of its own in the
task that searches it. A query searches its home cell first; the distance found
there bounds the cells it visits next.

Defined cases: vectors that are null, all zero, of another size than most, or
hold a null or non-finite component take no part, nor do null ids; ties go to
the smaller id; equal vectors are indexed once with their k + 1 smallest ids,
which is all a result can hold; repeated rows count once; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodcast.llm.common import by_group, map_arrow, materialise

PROJECTED = 16
CONFIDENCE = 0.95
SAMPLE = 20_000
CELL = 8192          # vectors of a block, about
MAX_DEPTH = 12       # at most 2^12 cells
LEAF = 512           # vectors of a leaf of a block's tree
QUERY_BLOCK = 2048   # queries that search a block together
SEED = 20240101


def chi2_quantile(p: float, degrees: int) -> float:
    """x with P(chi2 <= x) = p, for an even number of degrees of freedom."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * degrees + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Projection:
    """The projection of vectors (with the coordinate that makes norms equal) and of queries."""

    def __init__(self, size: int, largest: float):
        rng = np.random.default_rng(SEED)
        self.matrix = rng.standard_normal((size + 1, PROJECTED))
        self.largest = largest

    def vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, rest]) @ self.matrix

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


class CellTree:
    """Top of the kd-tree: splits in heap order, and the box of each cell."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, np.int64)
        self.at = np.zeros((1 << depth) - 1)
        self.low = np.full((1 << depth, PROJECTED), -np.inf)
        self.high = np.full((1 << depth, PROJECTED), np.inf)
        self._split(0, points, np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf))

    def _split(self, node: int, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        first_leaf = (1 << self.depth) - 1
        if node >= first_leaf:
            self.low[node - first_leaf], self.high[node - first_leaf] = low, high
            return
        axis = int(np.argmax(points.var(axis=0))) if len(points) else 0
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.at[node] = axis, at
        left_high, right_low = high.copy(), low.copy()
        left_high[axis], right_low[axis] = min(high[axis], at), max(low[axis], at)
        side = points[:, axis] <= at
        self._split(2 * node + 1, points[side], low, left_high)
        self._split(2 * node + 2, points[~side], right_low, high)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of ``point`` from each cell's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class BlockTree:
    """kd-tree of one block: rows in leaf order, and each leaf's tight box."""

    def __init__(self, points: np.ndarray):
        order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                order.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = np.argpartition(points[rows, axis], len(rows) // 2)
            todo += [rows[half[:len(rows) // 2]], rows[half[len(rows) // 2:]]]
        self.leaves = order
        self.low = np.stack([points[r].min(axis=0) for r in order])
        self.high = np.stack([points[r].max(axis=0) for r in order])

    def near_first(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        d = (gap * gap).sum(axis=1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _search_block(projection: Projection, size: int, k: int, quantile: float):
    """Search one block's vectors (rows with ids) by the queries that came to it (rows with query)."""
    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = t.column("query").is_valid().to_numpy()
        if is_query.all() or not is_query.any():
            return
        x = _matrix(t.column("vec"), size)
        data, asks = x[~is_query], x[is_query]
        ids = [np.array(i, np.int64) for i in t.column("ids").filter(pa.array(~is_query)).to_pylist()]
        smallest = np.array([i[0] for i in ids])
        names = t.column("query").filter(pa.array(is_query)).to_numpy()
        bound = t.column("bound").filter(pa.array(is_query)).to_numpy(zero_copy_only=False)
        points, wanted = projection.vectors(data), projection.queries(asks)
        tree = BlockTree(points)
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for name, q, p, d_k in zip(names.tolist(), asks, wanted, bound):
            fixed = q @ q + projection.largest   # distance^2 = fixed - 2 * inner product
            limit = np.inf if np.isnan(d_k) else d_k
            rows, score = np.zeros(0, np.int64), np.zeros(0)
            order, lower = tree.near_first(p)
            for leaf, r2 in zip(order, lower):
                if r2 > quantile * limit:
                    break
                at = tree.leaves[leaf]
                diff = points[at] - p
                at = at[np.einsum("ij,ij->i", diff, diff) <= quantile * limit]
                rows = np.concatenate([rows, at])
                score = np.concatenate([score, data[at] @ q])
                if len(rows) > k + 1:
                    best = np.lexsort((smallest[rows], -score))[:k + 1]
                    rows, score = rows[best], score[best]
                    limit = min(limit, max(fixed - 2 * score[-1], 0.0))
            if not len(rows):
                continue
            exact = np.cumsum(data[rows] * q, axis=1)[:, -1]   # summed in order
            found = np.concatenate([ids[r] for r in rows])
            score = np.repeat(exact, [len(ids[r]) for r in rows])
            score, found = score[found != name], found[found != name]
            best = np.lexsort((found, -score))[:k]
            out.append((name, found[best], score[best]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)),
                 pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                ["query", "found", "score"])
    return run


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    return (vec.isNotNull() & (F.size(vec) > 0)
            & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0))


def _place(df: DataFrame, vec: str, tree, projection: Projection, size: int, as_query: bool) -> DataFrame:
    """``df`` with the cell of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(vec), size)
                p = projection.queries(x) if as_query else projection.vectors(x)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.cells(p))],
                                                 [*b.schema.names, "cell"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, f"{fields}, cell long")


def _visits(df: DataFrame, tree, projection: Projection, size: int, quantile: float) -> DataFrame:
    """The other cells each query has to visit, given its bound (d_k squared, null: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = projection.queries(_matrix(b.column("vec"), size))
            home = b.column("cell").to_numpy()
            bound = b.column("bound").to_numpy(zero_copy_only=False)
            rows, cells = [], []
            for i in range(b.num_rows):
                near = np.ones(1 << tree.value.depth, bool)
                if not np.isnan(bound[i]):
                    near = tree.value.distances(p[i]) <= quantile * bound[i]
                near[home[i]] = False
                c = np.flatnonzero(near)
                rows.append(np.full(len(c), i))
                cells.append(c)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("query").take(take), b.column("vec").take(take), b.column("bound").take(take),
                 pa.array(np.concatenate(cells).astype(np.int64))], ["query", "vec", "bound", "cell"])
    return map_arrow(df, run, f"query long, vec {df.schema['vec'].dataType.simpleString()}, bound double, cell long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k vectors of largest inner product found,
    without the query's own id; rank from 1, ties to the smaller id."""
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
            F.col("id").isNotNull() & usable(F.col("vec")))

    spark = vectors.sparkSession
    rows = clean(vectors)
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("largest")).orderBy(
        F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total = sizes["size"], sizes["n"]
    projection, quantile = Projection(size, sizes["largest"]), chi2_quantile(confidence, PROJECTED)

    rows = rows.where(F.size("vec") == size)
    # equal vectors once, with their smallest ids
    same = Window.partitionBy("vec").orderBy("id")
    distinct = (rows.distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
                .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(total / CELL))))
    share = min(1.0, SAMPLE / total)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toArrow()
    sample = projection.vectors(_matrix(picked.column("vec"), size)) if picked.num_rows else np.zeros((0, PROJECTED))
    tree = spark.sparkContext.broadcast(CellTree(sample, depth))   # at most 2^MAX_DEPTH boxes

    indexed = materialise(_place(distinct, "vec", tree, projection, size, False), "indexed")
    cells = indexed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))   # at most 2^MAX_DEPTH rows
    asked = materialise(_place(clean(queries).where(F.size("vec") == size).distinct().withColumnRenamed("id", "query"),
                               "vec", tree, projection, size, True), "queries")

    def found(visits: DataFrame) -> DataFrame:
        """Results of (query, vec, bound, cell) rows in their cells."""
        load = (cells.join(visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")), "cell"))
        data = (indexed.join(load, "cell")
                .withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .select("cell", "block", "part", "vec", "ids", F.lit(None).cast("long").alias("query"),
                        F.lit(None).cast("double").alias("bound")))
        asks = (visits.join(load, "cell")
                .withColumn("part", F.pmod(F.xxhash64("query", "vec"), F.col("parts")).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select("cell", "block", "part", "vec", F.lit(None).cast("array<bigint>").alias("ids"), "query", "bound"))
        hits = by_group(data.unionByName(asks), ["cell", "block", "part"],
                        _search_block(projection, size, k, quantile), "query long, found long, score double")
        return best(hits)

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
        return (hits.groupBy("query", "found").agg(F.max("score").alias("score"))
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

    home = materialise(found(asked.withColumn("bound", F.lit(None).cast("double"))).drop("rank"), "home")
    kth = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounded = (asked.join(kth, "query", "left").withColumn(
        "bound", F.when(F.col("n") >= k, F.greatest(norm + F.lit(float(projection.largest)) - 2 * F.col("low"), F.lit(0.0))))
        .select("query", "vec", "cell", "bound"))
    away = found(materialise(_visits(bounded, tree, projection, size, quantile), "visits")).drop("rank")
    return best(home.unionByName(away)).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                                               F.col("found").alias("vec_id"), "score")
