"""Exact top-k search by inner product with a vector-approximation file.

Components become whole numbers, floor(64 x). Each dimension is cut into cells
(``BITS`` bits), and the approximation file holds only the cells of each vector.
Scanning it gives a lower and an upper bound of every inner product; the k-th
largest lower bound parts the candidates from the rest. Their exact vectors are
then read in the order of the upper bounds, some at a time, until no bound
reaches the k-th score found.

Equal vectors are one entry of the file, which carries the smallest ids that can
be among the results, and equal queries are asked once; so a vector that a
third of all rows share costs one entry and one query. The file is cut into
blocks of a size that follows the number of vectors and partitions; every query
meets every block of its length, in batches that stream past the block.

The cells' edges come from a bounded sample (``SAMPLE`` vectors) and from the
least and largest component of all vectors; they set the cost only, results are exact.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of different length are not compared; empty vectors have score
0 with each other; a null id takes no part; repeated rows (one id, one vector)
count once, and rows of one id with different vectors count each, each asking
for its own; a score beyond 64 bits is cut to the largest; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodcast.llm.common import by_group, map_arrow, materialise, shuffle_partitions

SCALE = 64
BITS = 5             # of a cell
SAMPLE = 4096        # vectors whose components set the cells
BLOCK = 1 << 17      # vectors of a block at most
SLAB = 1 << 11       # vectors compared with a batch of queries at a time
ASKED = 256          # queries in such a batch
ROUND = 64           # candidates that are read first; each later round reads four times as many
ROUND_MOST = 1 << 14
SALTS = 8            # parts that the rows asking one vector are dealt over
EXACT = 2.0 ** 53    # doubles hold all whole numbers below


# ---- whole-number vectors ------------------------------------------------------

def whole(components: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * components.astype(np.float64))


def packed(v: np.ndarray) -> bytes:
    """A vector of whole numbers in 16-bit numbers if they fit, in doubles otherwise."""
    return v.astype("<i2").tobytes() if not len(v) or np.abs(v).max() < 32768 else v.astype("<f8").tobytes()


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        if dims:
            out[k] = np.frombuffer(r, "<i2" if len(r) == 2 * dims else "<f8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows, as whole numbers of 64 bits (cut to their range)."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    x = [[int(v) for v in row] for row in a]
    y = [[int(v) for v in row] for row in b]
    ends = np.iinfo(np.int64)
    return np.array([[min(ends.max, max(ends.min, sum(p * q for p, q in zip(r, s)))) for s in y] for r in x], np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean vectors as whole numbers, with a digest that stands for the vector."""
    for b in batches:
        column, ids = b.column("vec"), b.column("id")
        values, offsets = column.values, column.offsets.to_numpy()
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)   # null: not a number
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        fine = column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        rows = {"id": [], "key": [], "dims": [], "vec": []}
        for k in np.flatnonzero(fine & (bad[offsets[1:]] == bad[offsets[:-1]])).tolist():
            v = whole(flat[offsets[k]:offsets[k + 1]])
            if not np.isfinite(v).all():   # beyond doubles once scaled
                continue
            data = packed(v)
            rows["id"].append(ids[k].as_py())
            rows["key"].append(hashlib.blake2b(data, digest_size=16, salt=len(v).to_bytes(8, "little")).digest())
            rows["dims"].append(len(v))
            rows["vec"].append(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["id"], pa.int64()), pa.array(rows["key"], pa.binary()), pa.array(rows["dims"], pa.int32()),
             pa.array(rows["vec"], pa.binary())], list(rows))


def encoded(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")),
                     _encode, "id long, key binary, dims int, vec binary")


# ---- the approximation file ------------------------------------------------------

def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the largest component in each dimension of a task's vectors, by length."""
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for b in batches:
        dims = b.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            v = unpacked([r.as_py() for r in b.column("vec").filter(pa.array(dims == d))], d)
            low[d] = np.minimum(low[d], v.min(axis=0)) if d in low else v.min(axis=0)
            high[d] = np.maximum(high[d], v.max(axis=0)) if d in high else v.max(axis=0)
    for d in low:
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(np.arange(d, dtype=np.int32)), pa.array(low[d]), pa.array(high[d])],
            ["dims", "at", "low", "high"])


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """First and last whole number of each cell (rows: dimensions, columns: cells).

    The cells' ends lie halfway between cells of equal population and of equal
    width: narrow where vectors are many, and none too wide at the ends.
    """
    cells = 1 << bits
    share = np.arange(1, cells) / cells
    even = low[:, None] + (high - low)[:, None] * share
    ends = np.floor((np.quantile(sample, share, axis=0).T + even) / 2 if len(sample) else even)
    ends = np.minimum(ends, high[:, None])
    last = np.concatenate([ends, high[:, None]], axis=1)
    first = np.concatenate([low[:, None], np.minimum(ends + 1, high[:, None])], axis=1)
    return first, last


def cells_of(v: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    out = np.empty(v.shape, np.uint8)
    for j in range(v.shape[1]):
        out[:, j] = np.searchsorted(last[j, :-1], v[:, j], "left")
    return out


def pack_cells(c: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.packbits(((c[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1).reshape(len(c), -1), axis=1)


def unpack_cells(rows: np.ndarray, dims: int, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(rows, axis=1)[:, :dims * bits].reshape(len(rows), dims, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def bounds(queries: np.ndarray, cells: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and the vectors in the cells."""
    at = np.arange(cells.shape[1])
    lo, hi = first[at, cells], last[at, cells]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        below, above = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
        most = np.abs(queries).max(initial=0) * max(np.abs(first).max(initial=0), np.abs(last).max(initial=0)) * len(at)
        if not most < EXACT:   # doubles round here: widen by more than their error; what is no number bounds nothing
            slack = (np.abs(queries) @ np.maximum(np.abs(lo), np.abs(hi)).T) * 2.0 ** -40 + 1
            below, above = np.nan_to_num(below - slack, nan=-np.inf), np.nan_to_num(above + slack, nan=np.inf)
    return below, above


def _file(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                mine = b.filter(pa.array(dims == d))
                v = unpacked(mine.column("vec").to_pylist(), d)
                codes = pack_cells(cells_of(v, edges[d][1])) if d else np.zeros((len(v), 0), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [mine.column("gid"), mine.column("dims"), pa.array([r.tobytes() for r in codes], pa.binary())],
                    ["gid", "dims", "cells"])
    return run


def _scan(shared, top: int, found: bool):
    """Queries stream past the block that a task holds (its rows come first).

    First scan: the ``top`` largest lower bounds of each query in the block.
    Second one (``found``): the entries whose upper bound reaches the query's limit.
    """
    def answer(block, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, edges) -> Iterator[pa.RecordBatch]:
        gids, codes, d = block
        best = np.full((len(q), 0), 0.0)
        for lo in range(0, len(gids), SLAB):
            cells = unpack_cells(codes[lo:lo + SLAB], d)
            below, above = bounds(q, cells, *edges)
            if found:
                a, b = np.nonzero(above >= limit[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a]), pa.array(gids[lo + b]), pa.array(above[a, b])], ["query", "gid", "bound"])
            else:
                best = np.concatenate([best, below], axis=1)
                if best.shape[1] > top:
                    best = -np.partition(-best, top - 1, axis=1)[:, :top]
        if not found:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(best), pa.list_(pa.float64()))], ["query", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        key, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "block", "asks")]
            cut = np.zeros(b.num_rows, bool)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            at = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
            for lo, hi in zip(at, at[1:]):
                d, one, asks = (c[lo] for c in cols)
                part = b.slice(lo, hi - lo)
                if (d, one) != key:
                    key, parts, block = (d, one), [], None
                if not asks:
                    parts.append((part.column("gid").to_numpy(), _matrix(part.column("data"), d * BITS)))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), int(d))
                    parts = []
                for k in range(0, part.num_rows, ASKED):
                    some = part.slice(k, ASKED)
                    yield from answer(block, some.column("gid").to_numpy(), unpacked(some.column("data").to_pylist(), int(d)),
                                      some.column("limit").to_numpy(zero_copy_only=False), edges[int(d)])
    return run


def _matrix(column: pa.Array, bits: int) -> np.ndarray:
    """Rows of packed cells as bytes."""
    width = -(-int(bits) // 8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# ---- reading the exact vectors ----------------------------------------------------

def _exact(top: int):
    """Scores of one query's candidates of a round; its ``top`` best ids."""
    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        d = t.column("dims")[0].as_py()
        mine = np.flatnonzero(asks == 0)
        query = np.flatnonzero(asks == 1)
        if not len(query) or not len(mine):
            return
        data = t.column("vec").to_pylist()
        score = products(unpacked([data[query[0]]], d), unpacked([data[k] for k in mine], d))[0]
        ids = [t.column("ids")[int(k)].as_py() for k in mine]
        flat = np.array([i for some in ids for i in some], np.int64)
        every = np.repeat(score, [len(some) for some in ids])
        order = np.lexsort((flat, ~every))[:top]   # ~: the order turned round, without overflow
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(order), t.column("query")[0].as_py(), np.int64)), pa.array(flat[order]), pa.array(every[order])],
            ["query", "id", "score"])
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` of each query row's ``k`` largest inner products with the
    rows of ``vectors``, its own id left out; ties go to smaller ids."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    top = k + 1   # a query's own id may be among them

    # entries: distinct vectors with their smallest ids
    rows = encoded(vectors, id_col, vec_col)
    least = (rows.dropDuplicates(["key", "id"]).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")))
             .where(F.col("n") <= top))
    entries = materialise(least.groupBy("key").agg(F.first("dims").alias("dims"), F.first("vec").alias("vec"),
                                                   F.sort_array(F.collect_list("id")).alias("ids"))
                          .withColumn("gid", F.monotonically_increasing_id()), "entries")
    asking = materialise(encoded(queries, id_col, vec_col).dropDuplicates(["key", "id"]), "asking")
    asked = materialise(asking.groupBy("key").agg(F.first("dims").alias("dims"), F.first("vec").alias("vec"))
                        .withColumn("query", F.monotonically_increasing_id()), "asked")

    sizes = {r["dims"]: r["n"] for r in entries.groupBy("dims").agg(F.count("*").alias("n")).collect()}   # one row a length
    found = map_arrow(entries.select("dims", "vec"), _extremes, "dims int, at int, low double, high double").groupBy("dims", "at").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dims", "at").toArrow().to_pydict()
    sample = entries.select("dims", "vec").orderBy(F.xxhash64("key")).limit(SAMPLE).collect()
    edges = {}
    for d in sizes:
        at = [i for i, x in enumerate(found["dims"]) if x == d]
        low, high = (np.array([found[c][i] for i in at], float) for c in ("low", "high"))
        edges[d] = cell_edges(unpacked([bytes(r["vec"]) for r in sample if r["dims"] == d], d), low, high)
    shared = spark.sparkContext.broadcast(edges)

    blocks = {d: max(-(-n // BLOCK), min(n, parts)) for d, n in sizes.items()}
    many = F.element_at(F.create_map(*[F.lit(x) for d, n in blocks.items() for x in (d, n)]), F.col("dims")) if blocks else F.lit(1)
    file = materialise(map_arrow(entries.select("gid", "dims", "vec"), _file(shared), "gid long, dims int, cells binary"), "cells")
    cells = file.select("dims", F.pmod(F.xxhash64("gid"), many).cast("int").alias("block"), F.lit(False).alias("asks"), "gid",
                        F.col("cells").alias("data"), F.lit(None).cast("double").alias("limit"))

    def scan(limits: DataFrame, found: bool, schema: str) -> DataFrame:
        """Every block of the file with every query of its length."""
        q = (limits.where(F.col("dims").isin(list(blocks)))
             .select("dims", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), F.lit(True).alias("asks"),
                     F.col("query").alias("gid"), F.col("vec").alias("data"), "limit"))
        both = cells.unionAll(q).repartition(parts, "dims", "block").sortWithinPartitions("dims", "block", "asks")
        return map_arrow(both, _scan(shared, top, found), schema)

    best = scan(asked.withColumn("limit", F.lit(None).cast("double")), False, "query long, best array<double>")
    limit = best.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("best")), False).alias("best")).select(
        "query", F.coalesce(F.get("best", F.lit(top - 1)), F.lit(float("-inf"))).alias("limit"))
    limited = materialise(asked.join(limit, "query").select("query", "dims", "vec", "limit"), "limits")
    candidates = materialise(scan(limited, True, "query long, gid long, bound double").withColumn(
        "place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "gid"))), "candidates")

    # read exact vectors in the order of the bounds, until no bound reaches the k-th score
    results = None
    done, step, left = 0, ROUND, candidates
    while True:
        now = left.where(F.col("place") <= done + step)
        read = now.select("query", "gid").join(entries.select("gid", "dims", "vec", "ids"), "gid").select(
            "query", "dims", F.lit(0).alias("asks"), "vec", "ids")
        ask = asked.join(now.select("query").distinct(), "query").select(
            "query", "dims", F.lit(1).alias("asks"), "vec", F.lit(None).cast("array<long>").alias("ids"))
        scored = by_group(read.unionAll(ask), ["query"], _exact(top), "query long, id long, score long")
        if results is not None:
            scored = scored.unionAll(results)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        results = materialise(scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).drop("n"), "results")
        done, step = done + step, min(4 * step, ROUND_MOST)
        kth = results.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == top)
        left = materialise(candidates.where(F.col("place") > done).join(kth, "query", "left").where(
            F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select(*candidates.columns), "left")
        if left.isEmpty():
            break

    lists = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(
        F.bitwise_not("score").alias("down"), "id", "score"))).alias("found"))   # ``top`` of each query at most
    lists = asked.select("query", "key").join(lists, "query").select(
        "key", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = asking.select("id", "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    listed = own.join(lists, ["key", "salt"]).select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda r: r["id"] != F.col("id")), 1, k)).alias("at", "r"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.id").alias(id_col), "r.score")
