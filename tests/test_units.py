"""Hand-written edge rows (FIXTURES.md part C)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pytest
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import (composite, time_bucket, url_slug,
                                      parse_number, parse_us_date, local_label)
from moodcast.operators.buckets import bucket_sums, moving_average, rollup_sums
from moodcast.operators.composite import composite_sentiment, recent_posts
from moodcast.operators.details import post_details
from moodcast.operators.ingest import scoring_gate
from moodcast.operators.quality import duplicate_keys, freshness
from moodcast.operators.series import chart_series, day_range, hour_range, scaled_prices
from moodcast.operators.newest import newest_n
from tests.conftest import rows


def test_composite_cases(spark):
    df = spark.createDataFrame(
        [(0.5, 10), (0.7, 1), (0.5, 0), (0.5, -3), (0.5, None), (None, 10)], "s double, score int")
    got = [r[0] for r in df.select(composite("s", "score")).collect()]
    assert got[0] == pytest.approx(0.5 * math.log(10), abs=1e-9)
    assert got[1:5] == [0.0, 0.0, 0.0, 0.0]
    assert got[5] is None


def test_bucket_edges_and_negative_epochs(spark):
    df = spark.createDataFrame([(3599,), (3600,), (7199,), (-1,)], "c long")
    assert [r[0] for r in df.select(time_bucket("c", 3600)).collect()] == [0, 3600, 3600, -3600]


def _posts(spark, data):
    return spark.createDataFrame(data, "id string, subreddit string, created long, selftext_length int")


def test_retention_and_body_filters(spark):
    as_of = 100 * P.DAY
    cut = as_of - 90 * P.DAY
    p = _posts(spark, [("a", "x", cut, 500), ("b", "x", cut + 1, 500), ("c", "x", cut + 1, 100),
                       ("d", "x", cut + 1, 101)])
    assert [r.id for r in recent_posts(p, as_of).orderBy("id").collect()] == ["b", "d"]


def test_scoring_gate_edges(spark):
    p = spark.createDataFrame(
        [("a", "t", 9, 200), ("b", "t", 10, 200), ("c", "t", 10, 100), ("d", None, 10, 200),
         ("e", "t", 10, 99)], "id string, selftext string, title_length int, selftext_length int")
    assert [r.id for r in scoring_gate(p).orderBy("id").collect()] == ["b", "c"]


def test_null_sentiment_ignored_by_sum(spark):
    posts = _posts(spark, [("a", "x", 10, 500), ("b", "x", 20, 500)])
    scores = spark.createDataFrame([("a", 10), ("b", 10)], "id string, score int")
    sents = spark.createDataFrame([("a", 0.5), ("b", None)], "id string, sentiment_value double")
    c = composite_sentiment(posts, scores, sents, as_of=1000, retention_days=1)
    s = bucket_sums(c, P.HOUR).collect()
    assert len(s) == 1 and s[0].sum_sentiment_score == pytest.approx(0.5 * math.log(10), abs=1e-9)


def test_sma_counts_rows_not_days(spark):
    d = spark.createDataFrame([(k * P.DAY, "x", float(v)) for k, v in
                               [(0, 1), (1, 2), (5, 3), (6, 4), (9, 5)]],
                              "timestamp long, subreddit string, sum_sentiment_score double")
    got = [r.sum_sentiment_score_sma for r in moving_average(d).orderBy("timestamp").collect()]
    assert got == [1.0, 1.5, 2.0, 2.5, 3.5]


def test_sma_ignores_null_sums(spark):
    d = spark.createDataFrame([(0, "x", 1.0), (P.DAY, "x", None), (2 * P.DAY, "x", 3.0)],
                              "timestamp long, subreddit string, sum_sentiment_score double")
    got = [r.sum_sentiment_score_sma for r in moving_average(d).orderBy("timestamp").collect()]
    assert got == [1.0, 1.0, 2.0]


def test_daily_equals_rollup_of_hourly(spark):
    import random
    rnd = random.Random(7)
    data = [(str(i), rnd.choice("abc"), rnd.randrange(0, 10 * P.DAY), rnd.uniform(-3, 3))
            for i in range(400)]
    comp = spark.createDataFrame(data, "id string, subreddit string, created long, sentiment_composite double")
    comp = comp.withColumn("sentiment_composite", F.col("sentiment_composite").cast("decimal(18,9)").cast("double"))
    direct = rows(bucket_sums(comp, P.DAY))
    rolled = rows(rollup_sums(bucket_sums(comp, P.HOUR, keep_exact=True), P.DAY))
    assert direct == rolled


def test_range_bounds_and_hour_chart_sma(spark):
    h = spark.createDataFrame([(0, "x", 1.0), (3600, "x", 2.0), (7200, "x", 3.0)],
                              "timestamp long, subreddit string, sum_sentiment_score double")
    s = chart_series(h, 0, 7200, use_sma=False)
    assert sorted(r.timestamp for r in s.collect()) == [0, 3600]
    z = chart_series(h, 0, 7200, use_sma=True)
    assert {r.value for r in z.collect()} == {0.0}


def test_constant_and_empty_price_series(spark):
    p = spark.createDataFrame([(0, "nasdaq", 5.0), (86400, "nasdaq", 5.0), (0, "bitcoin", None)],
                              "timestamp long, name string, value double")
    got = scaled_prices(p, 0, 10 * 86400).collect()
    assert len(got) == 2 and all(r.value is None for r in got)
    assert scaled_prices(p, 100 * 86400, 101 * 86400).count() == 0


def test_details_cases(spark):
    posts = spark.createDataFrame(
        [("a", "x", 100, "/r/a/comments/x1/my_post/", 10), ("b", "x", 200, "/r/a/comments/x2/other/", 20)],
        "id string, subreddit string, created long, url string, selftext_length int")
    scores = spark.createDataFrame([("b", 0.9, 5, 10, 3)],
                                   "id string, upvote_ratio double, ups int, score int, num_comments int")
    sents = spark.createDataFrame([("b", 0.12345)], "id string, sentiment_value double")
    d = {r.id: r for r in post_details(posts, scores, sents, "hour", "x", 0).collect()}
    assert d["a"].score is None and d["a"].composite_sentiment == 0.0 and d["a"].effect == "positive"
    assert d["a"].slug == "my_post" and d["a"].url == "https://www.reddit.com/r/a/comments/x1/my_post/"
    assert d["b"].sentiment_value == 0.123
    assert d["b"].composite_sentiment == pytest.approx(0.123 * math.log(10), abs=1e-9)
    assert d["a"].created == "1970-01-01 00:01:40"
    with pytest.raises(ValueError):
        post_details(posts, scores, sents, "week", "x", 0)


def test_parsers(spark):
    df = spark.createDataFrame([("01/31/2024", " 1,012.50 "), ("13/45/2024", "x"), ("1/31/2024", "7")],
                               "d string, v string")
    got = df.select(parse_us_date("d").alias("t"), parse_number("v").alias("v")).collect()
    assert got[0].t == 1706659200 and got[0].v == 1012.5
    assert got[1].t is None and got[1].v is None
    assert got[2].t == 1706659200 and got[2].v == 7.0


def test_local_labels(spark):
    df = spark.createDataFrame([(1706659200,)], "e long")
    r = df.select(local_label("e", "yyyy-MM-dd HH'h'", "Asia/Ho_Chi_Minh").alias("l")).first()
    assert r.l == "2024-01-31 07h"


def test_url_slug_edge(spark):
    df = spark.createDataFrame([("https://h/r/a/comments/x1/my_post/",), ("https://h/",), (None,)], "u string")
    assert [r[0] for r in df.select(url_slug("u")).collect()] == ["my_post", "", None]


def test_freshness_rules(spark):
    as_of = 100_000
    posts = spark.createDataFrame([(as_of - 3600,)], "created long")
    empty = spark.createDataFrame([], "timestamp long")
    hours = spark.createDataFrame([(as_of - 12 * 3600 - 1,)], "timestamp long")
    got = {r.check: r for r in freshness(posts, empty, hours, as_of).collect()}
    assert got["submissions"].stale is False
    assert got["analyzed_by_created_days"].stale is True and got["analyzed_by_created_days"].newest is None
    assert got["analyzed_by_created_hours"].stale is True
    assert got["analyzed_by_created_hours"].message.startswith("analyzed_by_created_hours")


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert rows(duplicate_keys(df, ["id"])) == [("a", 2)]


def test_newest_n_ties_by_id(spark):
    p = _posts(spark, [("b", "x", 5, 0), ("a", "x", 5, 0), ("c", "x", 1, 0), ("d", "y", 1, 0)])
    got = rows(newest_n(p, 2).select("subreddit", "id", "rank"))
    assert got == [("x", "a", 1), ("x", "b", 2), ("y", "d", 1)]
    assert rows(newest_n(p, 1, communities=["y"]).select("id")) == [("d",)]


def test_chart_ranges():
    as_of = 1706659200 + 5 * 3600 + 123  # 2024-01-31 05:02:03 UTC
    assert day_range(as_of, "UTC", 38) == (1706659200 - 38 * 86400, 1706659200)
    assert hour_range(as_of, "UTC", 24) == (as_of - 24 * 3600, 1706659200 + 5 * 3600)
    s, e = day_range(as_of, "Asia/Ho_Chi_Minh", 1)
    assert e - s == 86400 and (e + 7 * 3600) % 86400 == 0


def test_load_config(tmp_path):
    p = tmp_path / "cfg.json"
    p.write_text('{"default_subreddit": ["nasdaq_index", "wallstreetbets"], "display_day": 38, "display_hour": 24}')
    c = P.load_config(str(p))
    assert c.display_day == 38 and c.display_hour == 24 and c.visible == ("nasdaq_index", "wallstreetbets")


def test_freshness_stored_matches_full(spark, tmp_path):
    from moodcast.operators.quality import freshness_stored
    from moodcast.sources.store import with_dt, write_table
    from moodcast.sources.tables import read_table
    from moodcast import schemas as S
    as_of = 20 * 86400
    posts = with_dt(spark.createDataFrame([(str(i), i * 3600) for i in range(0, 20 * 24, 5)],
                                          "id string, created long"), "created")
    write_table(posts, str(tmp_path / "p"))
    hrs = with_dt(spark.createDataFrame([(3 * 86400, "x", 1.0)],
                                        "timestamp long, subreddit string, sum_sentiment_score double"), "timestamp")
    write_table(hrs, str(tmp_path / "h"))
    pt = read_table(spark, str(tmp_path / "p"), S.SUBMISSIONS)
    ht = read_table(spark, str(tmp_path / "h"), S.HOURLY)
    a = rows(freshness_stored(pt, ht, ht, as_of))
    b = rows(freshness(pt, ht, ht, as_of))
    assert a == b and any(r[3] for r in a)


def test_custom_scorer_hook(spark):
    from moodcast.operators.ingest import incremental_sentiment
    batch = spark.createDataFrame([("a", "title long enough", "x" * 120, 1)],
                                  "id string, title string, selftext string, polled_at long") \
        .withColumn("title_length", F.lit(17)).withColumn("selftext_length", F.lit(120))
    stored = spark.createDataFrame([], "id string, hash_check string, updated_timestamp long, sentiment_value double")

    def scorer(df, carry):
        return df.select("id", F.lit(0.25).alias("sentiment"), *carry)

    merged, fresh = incremental_sentiment(stored, batch, None, 99, version="model_v2", scorer=scorer)
    r = merged.first()
    assert r.sentiment_value == 0.25 and r.updated_timestamp == 99


def test_read_landed_json_missing_attributes(spark, tmp_path):
    from moodcast.sources.tables import read_landed
    p = tmp_path / "landing"
    p.mkdir()
    (p / "a.json").write_text(
        '{"id": "a", "subreddit": "x", "title": "Hello there", "created": 5, "selftext": "abc", "polled_at": 9}\n'
        '{"id": "b", "subreddit": "x", "title": "T", "created": 6, "author_fullname": "t2_q", "polled_at": 9}\n')
    got = {r.id: r for r in read_landed(spark, str(p)).collect()}
    assert got["a"].author_fullname is None and got["a"].selftext_length == 3 and got["a"].title_length == 11
    assert got["b"].selftext is None and got["b"].selftext_length == 0 and got["b"].author_fullname == "t2_q"


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-10**9, 10**10), min_size=1, max_size=30), st.sampled_from([3600, 86400]))
def test_bucket_contains_created(spark, created, w):
    df = spark.createDataFrame([(c,) for c in created], "c long")
    for c, b in df.select("c", time_bucket("c", w).alias("b")).collect():
        assert c - w < b <= c and b % w == 0


def test_aligned_analysis_whole_days_and_no_warmup(spark):
    from moodcast.plans.analysis import analysis_frames
    as_of = 10 * P.DAY + 5 * 3600          # mid-day: the plain cutoff is mid-day too
    posts = spark.createDataFrame([(str(i), "x", i * 3600 + 60, 500) for i in range(0, 240)],
                                  "id string, subreddit string, created long, selftext_length int")
    scores = spark.createDataFrame([(str(i), 10) for i in range(240)], "id string, score int")
    sents = spark.createDataFrame([(str(i), 0.5) for i in range(240)], "id string, sentiment_value double")
    plain = P.AnalysisParams(as_of=as_of, retention_days=5)
    aligned = P.AnalysisParams(as_of=as_of, retention_days=5, align=True)
    h0, d0 = analysis_frames(posts, scores, sents, plain)
    h1, d1 = analysis_frames(posts, scores, sents, aligned)
    first_plain = min(r.timestamp for r in h0.collect())
    first_aligned = min(r.timestamp for r in h1.collect())
    assert first_plain == 5 * P.DAY + 5 * 3600 and first_aligned == 5 * P.DAY
    assert min(r.timestamp for r in d1.collect()) == 5 * P.DAY + 3 * P.DAY
    assert min(r.timestamp for r in d0.collect()) == 5 * P.DAY


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["good", "bad", "not", "very", "GREAT", "but", "!", "?", ".", "meh", "\\n"]),
                min_size=0, max_size=60))
def test_polarity_bounded(spark, words):
    from moodcast.operators import text as T
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("great", 3.1)], "word string, valence double")
    df = spark.createDataFrame([("x", " ".join(words).replace("\\\\n", "\\n"))], "id string, text string")
    for r in T.sentence_polarity(df, "id", "text", lex).collect():
        assert -1 < r.polarity < 1
    s = T.text_sentiment(df, "id", "text", lex).first()
    assert s.sentiment is None or -1 < s.sentiment < 1


def test_read_valence_file(spark, tmp_path):
    from moodcast.sources.lexicon import read_valence_file
    p = tmp_path / "lex.txt"
    p.write_text('good\t1.9\t0.9\t[2, 1, 2]\n":)"\t2.0\t0.5\t[2, 2]\nBAD\t-2.5\t0.6\t[-3, -2]\nbroken line\n')
    got = dict((r.word, r.valence) for r in read_valence_file(spark, str(p)).collect())
    assert got == {"good": 1.9, '":)"': 2.0, "bad": -2.5}


def test_polled_communities_are_the_eight():
    from moodcast import params

    assert params.COMMUNITIES == ("wallstreetbets", "bitcoin", "stocks", "StockMarket",
                                  "investing", "cryptocurrency", "ethereum", "altcoin")


def test_score_fixtures_grow_with_events(spark):
    from moodcast.sources import fixtures as FX
    from moodcast.sources.tables import load

    small, large = (load(spark, f"/root/testdata/sf{s}", "events") for s in ("0.001", "0.01"))
    for view in (FX.scores_old, FX.scores_new, FX.submissions, FX.polled_posts):
        assert view(large).count() > 5 * view(small).count()


def test_repeated_lexicon_words_count_once(spark):
    from moodcast.operators.text import text_sentiment

    once = spark.createDataFrame([("good", 1.9)], "word string, valence double")
    df = spark.createDataFrame([(1, "a good day")], "id long, text string")
    got = [text_sentiment(df, "id", "text", lex).first()["sentiment"] for lex in (once, once.union(once))]
    assert got[0] == got[1]


def test_posts_without_poll_time_or_title_are_scored(spark):
    from moodcast.operators.ingest import incremental_sentiment, sentiment_todo
    batch = spark.createDataFrame(
        [("a", "title long enough", "x" * 120, None), ("b", "title long enough", "y" * 120, 7), ("c", None, "z" * 120, 7),
         ("d", "title long enough", "v" * 120, None), ("d", "title long enough", "w" * 120, 3), ("d", "title long enough", "v" * 120, None)],
        "id string, title string, selftext string, polled_at long") \
        .withColumn("title_length", F.lit(17)).withColumn("selftext_length", F.lit(120))
    stored = spark.createDataFrame([], "id string, hash_check string, updated_timestamp long, sentiment_value double")

    def scorer(df, carry):
        return df.select("id", F.substring("text", -1, 1).cast("string").alias("last"), *carry).select(
            "id", F.when(F.col("last") == "w", 2.0).otherwise(1.0).alias("sentiment"), *carry)

    keys = sentiment_todo(stored, batch)[1]
    fresh = {r.id: r.sentiment_value for r in incremental_sentiment(stored, batch, None, 9, scorer=scorer)[1].collect()}
    assert fresh == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 2.0} and keys.count() == len(fresh)
