"""Recall against brute force, exact scores, ties and awkward vectors."""

import numpy as np

from moodcast.llm import ann_srs as A
from moodcast.llm import queries as Q
from tests.conftest import SF_SMALL


def brute(ids, x, query, k):
    s = np.cumsum(x * x[list(ids).index(query)], axis=1)[:, -1]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != query][:k]
    return [(ids[i], s[i]) for i in order]


def test_query_recall_and_scores(spark):
    v = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = v.vec_id.tolist(), np.stack(v.embedding.values).astype(np.float64)
    rows = Q.QUERIES["op6_srs_neighbours"](spark, SF_SMALL).toPandas()
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        mine = rows[rows.query_id == q].sort_values("rank")
        want = brute(ids, x, q, 20)
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1)) and len(mine) == len(want)
        assert mine.score.is_monotonic_decreasing
        hits += len(set(mine.vec_id) & {i for i, _ in want})
        total += len(want)
    assert hits / total >= 0.9


def test_cells_and_blocks_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL", 64)
    monkeypatch.setattr(A, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24)) * rng.uniform(0.5, 2, (600, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = A.search(df, df.where("vec_id % 20 = 0"), k=10).toPandas()
    found = sum(len(set(rows[rows.query_id == q].vec_id) & {i for i, _ in brute(list(range(600)), x, q, 10)})
                for q in range(0, 600, 20))
    assert found / 300 >= 0.9


def test_awkward_vectors_and_ties(spark):
    good = [1.0, 0.0, 0.0]
    rows = [(i, good) for i in range(30)] + [(0, good), (40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0, None, 0.0]),
            (43, [float("nan"), 1.0, 1.0]), (44, [float("inf"), 1.0, 1.0]), (45, [1.0]), (46, []), (None, good), (60, [0.0, 2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    out = A.search(df, df.where("vec_id in (0, 20, 40, 41, 60)"), k=5).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(i, 1.0) for i in (1, 2, 3, 4, 5)], 20: [(i, 1.0) for i in range(5)], 60: [(i, 0.0) for i in range(5)]}
    assert A.search(df.limit(0), df).count() == 0 and A.search(df, df.limit(0)).count() == 0


def test_chi2_quantile():
    assert abs(A.chi2_quantile(0.95, 2) - 5.991464547) < 1e-6 and abs(A.chi2_quantile(0.95, 16) - 26.29622760) < 1e-6
