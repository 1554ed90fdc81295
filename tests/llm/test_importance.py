"""Resampling against a direct version, and exact ranks with ties."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodcast.llm import importance as I
from moodcast.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def direct(docs, target, n=1):
    """Rows (id, features, weight, score, rank) by plain loops."""
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text, n)[1]:
                counts[bucket(f)] += 1
    total_s, total_t = sum(s), sum(t)
    out, able = [], []
    for i, text in docs:
        w, fs = features(text, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
                for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None])
        if len(w) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:10 * len(able) // 100]):
        r[4] = k + 1
    return out


def same(rows, want):
    def key(r):
        return tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted((tuple(r) for r in want), key=key)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_direct_version(spark, sf):
    folder = SF_SMALL.replace("sf0.001", sf)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = Q.QUERIES["op11_importance_resampling"](spark, folder)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(rows.collect(), direct(docs, target))


def test_edge_rows_and_longer_features(spark):
    rows = [r[:2] for r in edge_rows()]
    # the repeated rows of id 2 and of no id have equal scores: ranks beyond the drawn ones are not given
    target = ["alpha beta", None, "", "Gamma DELTA é"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for n in (1, 3):
        same(I.resample(edge_docs(spark), bench, max_words=n).collect(), direct(rows, target, n))
    assert I.resample(empty_docs(spark), bench).count() == 0
    same(I.resample(edge_docs(spark), bench.limit(0)).collect(), direct(rows, []))


def test_words_split_as_the_pattern_does():
    random.seed(1)
    parts = ["a", "Z", "0", " ", "-", "é", "中", "`", "{", "[", "\x7f", "\x80", "\n", "\0", "İ", "\U0001F600"]
    for _ in range(300):
        text = "".join(random.choices(parts, k=random.randint(0, 30)))
        w, fs = features(text, 2)
        n, buckets = I.feature_buckets(text.encode(), 2)
        assert n == len(w) and buckets.tolist() == [zlib.crc32(f.encode()) % 10000 for f in fs]


def test_ranks_with_a_hot_score(spark):
    """A third of the rows share one score; ranks are exact and no task holds them all."""
    n = 30_000
    df = spark.range(n).repartition(7, "id").select(
        "id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) - 500).cast("long").alias("score"))
    got = {r["id"]: r["rank"] for r in I.exact_ranks(df, 16).collect()}
    score = {r["id"]: r["score"] for r in df.collect()}
    want = sorted(range(n), key=lambda i: (-score[i], i))
    assert [got[i] for i in want] == list(range(1, n + 1))
    keys = np.array(sorted((-score[i], i) for i in range(n)), I._KEY)
    cut = I.splitters(keys[::50], np.full(len(keys[::50]), 50), 16)
    sizes = np.bincount(np.searchsorted(cut, keys, "right"), minlength=16)
    assert sizes.max() < 2 * n / 16


def test_places_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).coalesce(1).select("id", (F.col("id") % 5).alias("score"))
        got = {r["id"]: r["rank"] for r in I.exact_ranks(df, 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [got[i] for i in sorted(range(200), key=lambda i: (-(i % 5), i))] == list(range(1, 201))
