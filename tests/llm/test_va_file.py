"""Exact search against all inner products, bounds, and awkward vectors."""

import math

import numpy as np
import pytest

from moodcast.llm import queries as Q
from moodcast.llm import va_file as V
from tests.conftest import SF_SMALL


def direct(rows, queries, k=20):
    """(query, rank, id, score) by whole numbers of any size."""
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.setdefault(i, set()).add(tuple(math.floor(64 * float(x)) for x in v))
    out = []
    for q in sorted(set(queries)):
        for v in clean.get(q, ()):
            found = [(-sum(a * b for a, b in zip(v, w)), i) for i, ws in clean.items() if i != q for w in ws if len(w) == len(v)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_products(spark, sf):
    folder = SF_SMALL.replace("sf0.001", sf)
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = Q.QUERIES["op12_va_top_k"](spark, folder)
    assert rows.columns == ["query_id", "rank", "vec_id", "score"]
    want = direct([(r["vec_id"], r["embedding"]) for r in table], [r["vec_id"] for r in table if r["vec_id"] % 20 == 0])
    assert sorted(map(tuple, rows.collect())) == want


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, 0.25, -0.5, 1.0]) for i in range(50)]            # a vector that many share
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [nan, 0.0, 0.0, 0.0]), (203, [inf, 0.0, 0.0, 0.0]),
             (None, [1.0, 1.0, 1.0, 1.0]), (220, [0.0] * 4), (240, []), (241, []), (260, [1.0, 2.0]), (261, [3.0, -1.0]),
             (280, [1e300, 0.0, 0.0, 0.0]), (20, rows[20][1]), (300, [1e307] * 4)]
    df = spark.createDataFrame([(i, v, i, "clash", 1) for i, v in rows],
                               "vec_id long, embedding array<double>, id long, key string, rank int")
    ends = (1 << 63) - 1

    def cut(r):
        return (*r[:3], min(ends, max(-ends - 1, r[3])))

    asked = [i for i, _ in rows if i is not None and i % 20 == 0]
    for k in (3, 20):
        got = V.search(df, df.where("vec_id % 20 = 0"), k=k).collect()
        # 1e307 * 64 is no double any more: it takes no part
        want = [r for r in map(cut, direct([r for r in rows if r[0] != 300], asked, k))]
        big = {r[0] for r in want if abs(r[3]) == ends or abs(r[3]) == ends + 1}
        mine = sorted(tuple(r) for r in got)
        for q in asked:
            if q not in big:   # cut scores tie
                assert [r for r in mine if r[0] == q] == [r for r in want if r[0] == q]
    assert V.search(df.limit(0), df).count() == 0 and V.search(df, df.limit(0)).count() == 0


def test_every_row_shares_one_vector(spark):
    df = spark.range(3000).selectExpr("id as vec_id", "array(0.5D, -0.25D) as embedding")
    got = V.search(df, df.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(by) == 150
    for q, found in by.items():
        assert [f[1] for f in sorted(found)] == [i for i in range(22) if i != q][:20]


def test_rounds_and_blocks_change_nothing(spark, monkeypatch):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    monkeypatch.setattr(V, "ROUND", 2)
    monkeypatch.setattr(V, "BLOCK", 7)
    got = V.search(df, df.where("vec_id % 20 = 0"), k=5).collect()
    assert sorted(map(tuple, got)) == direct(rows, [i for i, _ in rows if i % 20 == 0], 5)


def test_cells_and_bounds():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(500, 9)) * 50)
    first, last = V.cell_edges(v[:100], v.min(axis=0), v.max(axis=0))
    c = V.cells_of(v, last)
    at = np.arange(9)
    assert (first[at, c] <= v).all() and (v <= last[at, c]).all()
    assert (V.unpack_cells(V.pack_cells(c), 9) == c).all()
    below, above = V.bounds(v[:20], c, first, last)
    exact = V.products(v[:20], v)
    assert (below <= exact).all() and (exact <= above).all()
    big = np.array([[2.0 ** 40, 3.0]])
    assert V.products(big, big)[0, 0] == (1 << 63) - 1
