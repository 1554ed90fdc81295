"""Every stage keeps the columns of documents and works on what its predecessor kept."""

import corpus_pipeline as P
from moodcast.llm.common import materialise
from tests.conftest import SF_SMALL
from tests.llm.helpers import shingles, similar


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names, left = docs.columns, {}
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF_SMALL), name)
        if name != P.STAGES[-1][0]:
            assert docs.columns == names
            left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [left[n] for n, _ in P.STAGES[:-1]]
    assert all(set(b) <= set(a) for a, b in zip(kept, kept[1:]))
    sets = {i: shingles(t) for i, t in left["ngram_jaccard_join"].items()}
    assert not any(i < j and similar(a, b) for i, a in sets.items() for j, b in sets.items())
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(left["secret_scan"])
