"""Overlaps equal a direct search; substitutions are tolerated, clean texts are left alone."""

import itertools

import numpy as np

from moodcast.llm import decontaminate as D
from moodcast.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, empty_docs, sentence, words

BENCH = "item_id long, text string, id int"


def test_query_finds_every_shared_passage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    grams = {}
    for it in items:
        w = words(it["text"])
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k:k + 13]), set()).add(it["item_id"])
    want = set()
    for d in docs:
        w = words(d["text"])
        for k in range(len(w) - 12):
            want |= {(d["doc_id"], i) for i in grams.get(tuple(w[k:k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in Q.QUERIES["op1_benchmark_decontamination"](spark, SF_SMALL).collect()}
    assert want and want <= got
    # what is found beyond exact 13-word passages shares most words of a passage
    assert len(got - want) <= len(want) // 5


def test_segment_positions_and_substitutions(spark):
    item = words(sentence(40, 4))
    changed = list(item)
    for k in (5, 14, 22, 31):
        changed[k] = "zzz"
    text = sentence(30, 9) + " " + " ".join(changed) + " " + sentence(30, 8)
    docs = spark.createDataFrame([(1, text), (2, sentence(200, 9)), (3, " ".join(item[:8]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item), 1), (7, " ".join(item), 1), (8, "short item", 1)], BENCH)
    rows = D.overlaps(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["doc_start"], r["item_start"], r["n_words"], r["n_matched"], r["item_words"])
            for r in rows] == [(1, 7, 30, 0, 40, 36, 40)]
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()) == [2, 3]


def test_edge_rows(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, sentence(60, 1), 0), (None, sentence(40, 5), 0), (3, None, 0), (4, "", 0)], BENCH)
    rows = D.overlaps(docs, bench).collect()
    assert sorted({(r["doc_id"], r["item_id"]) for r in rows}, key=str) == sorted(
        [(1, 1), (2, 1), (3, 1), (None, None)], key=str)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in left if i is not None) == [4, 5, 6, 7, 8, 9, 10, 11, 12] and left.count(None) == 1


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, sentence(60, 1), 0)], BENCH)
    assert D.overlaps(empty_docs(spark), bench).count() == 0
    assert D.overlaps(edge_docs(spark), bench.limit(0)).count() == 0
    assert D.drop_contaminated(edge_docs(spark), bench.limit(0)).count() == 16


def test_best_segment_is_the_maximum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        same = rng.random(rng.integers(1, 15)) < 0.7
        score = np.where(same, 1, D.MISMATCH)
        best = max([0] + [score[a:z].sum() for a in range(len(same)) for z in range(a + 1, len(same) + 1)])
        a, z = D.best_segment(same)
        assert score[a:z].sum() == best


def _replaced(item, places):
    return [f"sub{k}" if k in places else w for k, w in enumerate(item)]


def test_exact_passage_beside_a_weak_one(spark):
    docs, bench = [], []
    for i, (exact, weak) in enumerate([(40, 200), (13, 100), (20, 100), (30, 200)]):
        item = words(sentence(exact + weak, 60 + i))
        bench.append((i, " ".join(item), 0))
        docs.append((i, " ".join(_replaced(item, range(exact + 3, exact + weak, 4)))))
    rows = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, BENCH)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(i, i) for i in range(4)]
    assert all(5 * r["n_matched"] >= 4 * r["n_words"] and r["n_matched"] >= 13 for r in rows)


def test_every_substitution_of_short_items_is_found(spark):
    docs, bench = [], []
    for n, s in ((13, 2), (14, 2), (15, 3)):
        item = words(sentence(n, 70 + n))
        bench.append((n, " ".join(item), 0))
        for places in itertools.combinations(range(n), s):
            docs.append((n * 1000 + len(docs), " ".join(_replaced(item, places))))
    # 13 and 14 words with one substitution too many, and an item that is too short
    bench.append((12, sentence(12, 90), 0))
    clean = [(1, " ".join(_replaced(words(bench[0][1]), (2, 6, 10)))), (2, " ".join(_replaced(words(bench[1][1]), (2, 6, 10)))),
             (3, sentence(12, 90))]
    rows = D.overlaps(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(bench, BENCH)).collect()
    whole = {r["doc_id"] for r in rows}
    cut = {d for d, t in docs if t.startswith("sub") or t.split()[-1].startswith("sub")}
    assert {d for d, _ in docs} - cut <= whole
    assert not whole & {1, 2, 3}


def test_widest_segment_is_the_best_that_keeps_the_identity():
    rng = np.random.default_rng(2)
    for _ in range(300):
        same = rng.random(rng.integers(1, 18)) < 0.7
        best = max([0] + [int(same[a:z].sum()) for a in range(len(same)) for z in range(a + 1, len(same) + 1)
                          if 5 * same[a:z].sum() >= 4 * (z - a)])
        a, z = D.widest_segment(same)
        assert same[a:z].sum() == best and 5 * best >= 4 * (z - a)
