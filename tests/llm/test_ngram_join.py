"""Jaccard classes and links equal brute force over all pairs; rows of every kind survive."""

import numpy as np
import pytest

from moodcast.llm import ngram_join as N
from moodcast.llm import queries as Q
from moodcast.llm.components import connected_components
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, sentence, shingles, similar


def brute(rows):
    """Per row: links, links between different sets, class (set of row numbers)."""
    sets = [shingles(t) for _, t in rows]
    link = [[i != j and similar(a, b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    change = True
    while change:
        change = False
        for i, row in enumerate(link):
            for j, on in enumerate(row):
                if on and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    change = True
    return [sum(r) for r in link], [len({sets[j] for j, on in enumerate(r) if on} - {sets[i]}) for i, r in enumerate(link)], label


def check(rows, got):
    links, other, label = brute(rows)
    ids = [i for i, _ in rows]

    def class_id(k):
        known = [ids[j] for j in range(len(rows)) if label[j] == label[k] and ids[j] is not None]
        return min(known) if known else None

    want = sorted(((ids[k], class_id(k), links[k], other[k]) for k in range(len(rows))), key=str)
    assert sorted(((r[0], r["class_id"], r["n_links"], r["n_class_links"]) for r in got), key=str) == want
    assert sum(r["keep"] for r in got) == len(set(label))


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(rows, Q.QUERIES["op9_ngram_jaccard_join"](spark, SF_SMALL).collect())


def test_edge_rows_equal_brute_force(spark):
    check([(r[0], r[1]) for r in edge_rows()], N.similarity_classes(edge_docs(spark)).collect())


def test_blocks_of_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(N, "TEXT_BLOCK", 3)
    base = sentence(80, 2).split()
    rows = [(100, " ".join(base))]
    for k in range(20):   # near copies of one text, all different
        w = list(base)
        w[3 * k + 4] = f"other{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, N.similarity_classes(df).collect())


def test_empty_table(spark):
    assert N.similarity_classes(empty_docs(spark)).count() == 0
    assert N.keep_one_of_each(empty_docs(spark)).columns == empty_docs(spark).columns


def test_keep_one_of_each_keeps_rows_whole(spark):
    docs = edge_docs(spark)
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [r["text"] for r in rows]
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12]
    assert len([t for t in texts if t is not None]) == 9 and all(r["id"] == "clash" for r in rows)


def test_pruning_table_is_the_posterior():
    for n, m in N.min_matches(0.8, 1e-3, 32, 16):
        # the posterior mass above the threshold by numeric integration of the Beta density
        x = np.linspace(0, 1, 200_001)[1:-1]

        def mass(k):
            log = k * np.log(x) + (n - k) * np.log1p(-x)
            d = np.exp(log - log.max())
            return d[x >= 0.8].sum() / d.sum()

        assert mass(m) >= 1e-3 > mass(m - 1)


@pytest.mark.parametrize("edges,want", [
    ([], {}),
    ([(2, 1), (3, 2), (9, 8), (5, 3), (7, 7)], {1: 1, 2: 1, 3: 1, 5: 1, 8: 8, 9: 8}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
])
def test_components(spark, edges, want):
    df = spark.createDataFrame([*edges, (None, 1)], "u long, v long")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want
