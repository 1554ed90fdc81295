"""Upsert semantics (SNK-3..6) and their properties."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from moodcast.operators.upsert import latest_per_key, upsert_posts, upsert_rows, upsert_scores
from tests.conftest import rows

SC = "id string, timestamp long, upvote_ratio double, ups int, score int, num_comments int"


def test_score_repoll_unchanged_keeps_row(spark):
    stored = spark.createDataFrame([("a", 1, 0.5, 1, 1, 1)], SC)
    batch = spark.createDataFrame([("a", 9, 0.5, 1, 1, 1)], SC)
    merged, act = upsert_scores(stored, batch)
    assert rows(merged) == [("a", 1, 0.5, 1, 1, 1)]
    assert rows(act.select("changed")) == [(False,)]


def test_score_change_replaces_with_time(spark):
    stored = spark.createDataFrame([("a", 1, 0.5, 1, 1, 1)], SC)
    batch = spark.createDataFrame([("a", 9, 0.5, 1, 1, 2)], SC)
    assert rows(upsert_scores(stored, batch)[0]) == [("a", 9, 0.5, 1, 1, 2)]


def test_change_runs_keep_start_of_last_run(spark):
    stored = spark.createDataFrame([], SC)
    batch = spark.createDataFrame([("a", 1, 0.5, 1, 1, 1), ("a", 2, 0.5, 2, 2, 2), ("a", 3, 0.5, 2, 2, 2)], SC)
    assert rows(upsert_scores(stored, batch)[0]) == [("a", 2, 0.5, 2, 2, 2)]
    aba = spark.createDataFrame([("b", 1, 0.5, 1, 1, 1), ("b", 2, 0.5, 2, 2, 2), ("b", 3, 0.5, 1, 1, 1)], SC)
    assert rows(upsert_scores(stored, aba)[0]) == [("b", 3, 0.5, 1, 1, 1)]


PS = "id string, subreddit string, author_fullname string, url string"


def test_post_overlay_null_overwrites_and_missing_columns_kept(spark):
    stored = spark.createDataFrame([("a", "x", "t2_1", "/u")], PS)
    batch = spark.createDataFrame([("a", "x", None, 5), ("b", "y", "t2_2", 5)],
                                  "id string, subreddit string, author_fullname string, polled_at long")
    merged, act = upsert_posts(stored, batch, ["subreddit", "author_fullname"])
    assert rows(merged) == [("a", "x", None, "/u"), ("b", "y", "t2_2", None)]
    assert rows(act.select("id", "action")) == [("a", "changed"), ("b", "new")]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("k", 1, "p1", 0), ("k", 2, "p2", 0), ("k", 3, "p2", 1)],
                               "k string, v int, page string, pos int")
    assert rows(latest_per_key(df, ["k"], ["page", "pos"])) == [("k", 3, "p2", 1)]


polls = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 2), st.integers(0, 2)),
                 min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(polls)
def test_split_batch_equals_one_batch_and_idempotent(spark, data):
    snaps = [(k, t, 0.5, u, s, 0) for t, (k, u, s) in enumerate(data)]
    stored = spark.createDataFrame([("a", -1, 0.5, 0, 0, 0)], SC)
    one = rows(upsert_scores(stored, spark.createDataFrame(snaps, SC))[0])
    half = len(snaps) // 2
    first = upsert_scores(stored, spark.createDataFrame(snaps[:half], SC))[0]
    first = spark.createDataFrame(first.collect(), SC)
    two = upsert_scores(first, spark.createDataFrame(snaps[half:], SC))[0] if snaps[half:] else first
    assert rows(two) == one
    again = upsert_scores(spark.createDataFrame(one, SC), spark.createDataFrame(snaps, SC))[0]
    # replaying a batch keeps the metric state (times of unchanged runs stay)
    assert [r[2:] for r in rows(again)] == [r[2:] for r in one]


def test_upsert_rows_is_idempotent(spark):
    t = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], "timestamp long, subreddit string, v double")
    u = spark.createDataFrame([(2, "x", 5.0), (3, "x", 6.0)], "timestamp long, subreddit string, v double")
    once = upsert_rows(t, u, ["timestamp", "subreddit"])
    twice = upsert_rows(spark.createDataFrame(once.collect(), once.schema), u, ["timestamp", "subreddit"])
    assert rows(once) == rows(twice) == [(1, "x", 1.0), (2, "x", 5.0), (3, "x", 6.0)]


def test_redelivered_post_rows_count_once(spark):
    stored = spark.createDataFrame([], PS)
    row = ("a", "x", "t2_1", 5)
    batch = spark.createDataFrame([row, row], "id string, subreddit string, author_fullname string, polled_at long")
    merged, act = upsert_posts(stored, batch, ["subreddit", "author_fullname"])
    assert rows(act.select("id", "action")) == [("a", "new")]
    assert merged.count() == 1
