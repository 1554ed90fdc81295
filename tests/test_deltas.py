"""Sums kept by signed deltas equal the full run, whatever the posts do."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.deltas import EXACT, KEYS, apply_deltas, restated_average, signed_deltas
from moodcast.operators.buckets import moving_average
from moodcast.plans.analysis import run_analysis
from moodcast.plans.delta_job import run_delta, touched_contributions
from moodcast.plans.ingest_job import run_ingest
from moodcast.sources.store import as_store, with_dt
from tests.conftest import rows

START = 1_704_067_200
STATE = f"timestamp long, subreddit string, exact {EXACT}, n_values long, n_posts long, run string"
PARAMS = P.AnalysisParams(as_of=START + 20 * P.DAY)


def raw(k, t, score, body=150):
    created = START + k * 17_000
    return (f"p{k}", f"r{k % 3}", "a good title", False, created, "u", "good " * (body // 5), None, "url", body, 12, 0.5, 1, score, 2,
            created + t)


def results(spark, root):
    store = as_store(root)
    return [sorted(map(tuple, store.read(spark, n, s).select(*s.fieldNames()).collect())) for n, s in (
        ("analyzed_by_created_hours", S.HOURLY), ("analyzed_by_created_days", S.DAILY))]


def test_polls_back_and_forth_equal_the_full_run(spark, tmp_root):
    lexicon = spark.createDataFrame([("good", 1.9)], S.LEXICON)
    first = [raw(k, 100, 3 + k) for k in range(40)]
    batches = [first, [raw(k, 200, 50) for k in (3, 4, 20)] + [raw(41, 0, 9)],       # others' scores move, a post is new
               [raw(k, 300, 3 + k) for k in (3, 4, 20)] + [raw(10, 50, 1)],          # back again; a late poll
               [raw(7, 400, 10, body=100)]]                                          # too short now: it leaves the sums
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, S.RAW_POSTS)
        run_ingest(spark, f"{tmp_root}/delta", df, lexicon, START, f"b{n}")
        touched = with_dt(df, "created").select("id", "dt")
        run_delta(spark, f"{tmp_root}/delta", PARAMS, touched, f"run{n}")
        if n == 1:
            before = results(spark, f"{tmp_root}/delta")
            run_delta(spark, f"{tmp_root}/delta", PARAMS, touched, f"run{n}")   # a retry adds nothing twice
            assert results(spark, f"{tmp_root}/delta") == before
    everything = spark.createDataFrame([r for b in batches for r in b], S.RAW_POSTS)
    run_ingest(spark, f"{tmp_root}/full", everything, lexicon, START, "all")
    run_analysis(spark, f"{tmp_root}/full", PARAMS, "full")
    for mine, full in zip(results(spark, f"{tmp_root}/delta"), results(spark, f"{tmp_root}/full")):
        assert sorted(set(mine) ^ set(full)) == []
    assert len(results(spark, f"{tmp_root}/full")[0]) > 20

    # what a run reads: touched dates of the post tables, and only the touched posts reach the joins
    touched = with_dt(spark.createDataFrame(batches[1], S.RAW_POSTS), "created").select("id", "dt")
    dates = sorted(r["dt"] for r in touched.select("dt").distinct().collect())
    _, after = touched_contributions(spark, f"{tmp_root}/delta", PARAMS, touched, dates)
    plan = after._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    scans = [line for line in physical.splitlines() if "FileScan parquet" in line]
    assert len(scans) >= 3 and all("dt#" in s.split("PartitionFilters: ")[1] for s in scans)
    assert physical.count("LeftSemi") >= 3
    assert sorted(r["id"] for r in after.collect()) == sorted(r[0] for r in batches[1])


def test_deltas_of_random_changes(spark):
    """States after several runs equal sums over the present contributions, NULL values and emptied buckets included."""
    rng = random.Random(6)
    schema = "id string, created long, subreddit string, value decimal(18,9)"
    posts, state = {}, spark.createDataFrame([], STATE)
    for n in range(4):
        new = {}
        for i in rng.sample(range(30), 12):
            value = rng.choice([None, Decimal("1.5"), Decimal("-0.25"), Decimal(0)])
            new[i] = rng.choice([None, (f"p{i}", START + i * 2000, f"r{i % 2}", value)])
        before = spark.createDataFrame([posts[i] for i in new if posts.get(i)], schema)
        after = spark.createDataFrame([r for r in new.values() if r], schema)
        deltas = signed_deltas(before, after, P.HOUR)
        posts |= new
        state = spark.createDataFrame(apply_deltas(state, deltas, f"run{n}").collect(), STATE)
        assert rows(apply_deltas(state, deltas, f"run{n}")) == rows(state)
    want = {}
    for r in filter(None, posts.values()):
        key = (r[1] // P.HOUR * P.HOUR, r[2])
        total, values, count = want.get(key, (Decimal(0), 0, 0))
        want[key] = (total + (r[3] or 0), values + (r[3] is not None), count + 1)
    got = {(r["timestamp"], r["subreddit"]): (r["exact"], r["n_values"], r["n_posts"]) for r in state.collect() if r["n_posts"]}
    assert got == want
    assert all(r["exact"] == 0 and r["n_values"] == 0 for r in state.collect() if not r["n_posts"])


def test_average_is_restated_where_it_may_change(spark):
    rng = random.Random(1)
    for _ in range(3):
        old = {(d, s): [Decimal(rng.randrange(9)), 1, 1, "x"] for d in rng.sample(range(30), 18) for s in "ab"}
        new = {k: list(v) for k, v in old.items()}
        for k in rng.sample(sorted(new), 4):
            new[k] = rng.choice([[Decimal(77), 1, 1, "run"], [Decimal(0), 0, 0, "run"]])
        new[31, "a"] = [Decimal(5), 1, 1, "run"]

        def frame(state):
            return spark.createDataFrame([(*k, *v) for k, v in sorted(state.items())], STATE)

        def average(state):
            live = frame(state).where("n_posts > 0").withColumn(
                "sum_sentiment_score", F.when(F.col("n_values") > 0, F.col("exact").cast("double")))
            return {tuple(r[:2]): tuple(r) for r in moving_average(live).select(
                *KEYS, "sum_sentiment_score", "sum_sentiment_score_sma").collect()}

        restated = {tuple(r[:2]): tuple(r) for r in restated_average(frame(new), F.col("run") == "run").collect()}
        want = average(new)
        kept = {k: v for k, v in average(old).items() if k in want}
        assert kept | restated == want and len(restated) < len(want)
