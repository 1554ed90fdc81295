"""Late polls: one result for every order and every split of the polls."""

import itertools
import random

from pyspark.sql import functions as F

from moodcast import schemas as S
from moodcast.operators.history import history_of, latest_scores, newest_polls, splice
from moodcast.plans.ingest_job import run_ingest
from moodcast.sources.store import as_store
from moodcast.streaming.jobs import start_ingest_stream
from tests.conftest import rows

POLL = "id string, timestamp long, upvote_ratio double, ups int, score int, num_comments int"
HISTORY = "id string, timestamp long, until long, polls array<long>, upvote_ratio double, ups int, score int, num_comments int"


def poll(i, t, score, ratio=0.5):
    return (i, t, ratio, 1, score, 2)


def direct(polls):
    """Runs of each post by a loop over its polls in order of time."""
    points = {}
    for i, t, *m in polls:
        best = points.setdefault((i, t), tuple(m))
        key = [(x is not None, x) for x in best], [(x is not None, x) for x in m]
        points[i, t] = best if key[0] >= key[1] else tuple(m)
    out = []
    for (i, t), m in sorted(points.items()):
        if out and out[-1][0] == i and out[-1][4:] == m:
            out[-1] = (i, out[-1][1], t, out[-1][3] + [t], *m)
        else:
            out.append((i, t, t, [t], *m))
    return out


def test_every_order_and_split(spark):
    polls = [poll("a", 100, 3), poll("a", 200, 5), poll("a", 300, 5), poll("a", 400, 3)]
    want = direct(polls)
    for n, order in enumerate(itertools.permutations(polls)):
        if n % 5:
            continue
        cut = n % 4
        h = spark.createDataFrame([], HISTORY)
        for part in (order[:cut], order[cut:]):
            h = splice(h, spark.createDataFrame(list(part), POLL))
        assert rows(h) == sorted(want)
    late = splice(history_of(spark.createDataFrame([poll("a", 200, 5)], POLL)), spark.createDataFrame([poll("a", 100, 3)], POLL))
    assert rows(latest_scores(late)) == [poll("a", 200, 5)]   # the older poll does not win


def test_random_batches_equal_one_batch(spark):
    rng = random.Random(8)
    polls = [poll(f"p{rng.randrange(12)}", 100 * rng.randrange(15), rng.choice([1, 1, 2, None]), rng.choice([0.5, None]))
             for _ in range(250)]
    want = direct(polls)
    for seed in range(2):
        random.Random(seed).shuffle(polls)
        h = spark.createDataFrame([], HISTORY)
        for lo in range(0, 250, 90):
            h = splice(h, spark.createDataFrame(polls[lo:lo + 90], POLL))
            h = spark.createDataFrame(h.collect(), HISTORY)
        got = sorted(map(tuple, h.collect()), key=lambda r: r[:2])
        assert got == want
    again = splice(h, spark.createDataFrame(polls[:40], POLL))   # redelivered polls change nothing
    assert sorted(map(tuple, again.collect()), key=lambda r: r[:2]) == want


def test_newest_polls(spark):
    h = splice(spark.createDataFrame([], HISTORY), spark.createDataFrame([poll("a", 100, 1), poll("a", 300, 1), poll("b", 50, 1)], POLL))
    batch = spark.createDataFrame([("a", 100), ("b", 50)], "id string, polled_at long")
    assert rows(newest_polls(batch, h)) == [("b", 50)]


def raw(i, t, score, title="a title of some length"):
    created = 1_704_067_200
    return (i, "r", title, False, created, "u", "body " * 30, None, "url", 150, len(title), 0.5, 1, score, 2, created + t)


def lexicon(spark):
    return spark.createDataFrame([("title", 1.0)], S.LEXICON)


def tables(spark, root):
    store = as_store(root)
    return {n: sorted(map(str, store.read(spark, n, s).collect())) for n, s in (
        ("submissions", S.SUBMISSIONS), ("submission_scores", S.SUBMISSION_SCORES), ("score_history", S.SCORE_HISTORY))}


def test_ingest_of_a_late_batch(spark, tmp_root):
    polls = [raw("a", 100, 3, "an old title of a post"), raw("a", 300, 5), raw("a", 500, 5), raw("b", 200, 1)]
    for name, parts in (("all", [polls]), ("late", [polls[1:2], polls[2:], polls[:1]])):
        for k, part in enumerate(parts):
            report = run_ingest(spark, f"{tmp_root}/{name}", spark.createDataFrame(part, S.RAW_POSTS), lexicon(spark), 1, f"{name}{k}")
    assert report.counts["score_updates"] == 1 and report.counts["new_posts"] == 0
    assert tables(spark, f"{tmp_root}/late") == tables(spark, f"{tmp_root}/all")


def test_tables_from_before_the_history(spark, tmp_root):
    store = as_store(tmp_root)
    old = spark.createDataFrame([poll("a", 1_704_067_400, 5)], POLL).withColumn("dt", F.lit("2024-01-01").cast("date"))
    store.create(old, "submission_scores")
    run_ingest(spark, tmp_root, spark.createDataFrame([raw("a", 100, 3)], S.RAW_POSTS), lexicon(spark), 1, "x")
    assert [(r["timestamp"], r["score"]) for r in store.read(spark, "submission_scores", S.SUBMISSION_SCORES).collect()] == [
        (1_704_067_400, 5)]


def test_stream_with_a_late_file(spark, tmp_root):
    polls = [raw("a", 100, 3, "an old title of a post"), raw("a", 300, 5), raw("a", 500, 3), raw("b", 200, 1), raw("b", 400, 1)]
    landing = f"{tmp_root}/landing"
    for k, part in enumerate((polls[1:3], polls[3:], polls[:1])):   # the first poll lands last
        spark.createDataFrame(part, S.RAW_POSTS).coalesce(1).write.mode("append").parquet(landing)
        q = start_ingest_stream(spark, landing, f"{tmp_root}/stream", lexicon(spark), f"{tmp_root}/ckpt", as_of_fn=lambda b: 1)
        q.awaitTermination(120)
    run_ingest(spark, f"{tmp_root}/batch", spark.createDataFrame(polls, S.RAW_POSTS), lexicon(spark), 1, "batch")
    assert tables(spark, f"{tmp_root}/stream") == tables(spark, f"{tmp_root}/batch")
