"""Q-1: recent posts joined with their score and sentiment (FIL-1/2, JOIN-1/2, FN-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import composite
from moodcast.operators.joins import join_keys


def retention_cutoff(as_of: int, retention_days: int = P.RETENTION_DAYS,
                     align_to: int | None = None) -> int:
    """Oldest ``created`` kept is ``> cutoff``. ``align_to`` rounds the cutoff
    down to a bucket edge so the oldest bucket is not cut mid-way."""
    cut = int(as_of) - retention_days * P.DAY
    if align_to:
        cut = (cut // align_to) * align_to - 1
    return cut


def recent_posts(posts: DataFrame, as_of: int, retention_days: int = P.RETENTION_DAYS,
                 min_body: int = P.MIN_BODY_ANALYSED, align_to: int | None = None) -> DataFrame:
    """FIL-1 + FIL-2: ``created > as_of - days`` and ``selftext_length > min_body``.

    Both are plain column comparisons, so they become Parquet pushed filters;
    on a ``dt``-partitioned table the derived date bound prunes directories.
    """
    cut = retention_cutoff(as_of, retention_days, align_to)
    out = posts.filter((F.col("created") > F.lit(cut)) &
                       (F.col("selftext_length") > F.lit(int(min_body))))
    if "dt" in posts.columns:
        out = out.filter(F.col("dt") >= F.date_from_unix_date(F.lit(cut // P.DAY)))
    return out


def since_date(df: DataFrame, cut: int) -> DataFrame:
    """Static partition filter ``dt >= date(cut)`` on a table carrying the
    post's ``dt`` (no-op otherwise): scores and sentiments of posts older than
    the cutoff are never read."""
    if "dt" not in df.columns:
        return df
    return df.filter(F.col("dt") >= F.date_from_unix_date(F.lit(cut // P.DAY)))


def post_scores(posts: DataFrame, scores: DataFrame, join_on: list[str] | None = None) -> DataFrame:
    """JOIN-1 + PRJ-1: inner join on id, keep id, subreddit, created, score."""
    keys = join_on or join_keys(posts, scores)
    extra = [k for k in keys if k != "id"]
    return (posts.select("id", "subreddit", "created", *extra)
            .join(scores.select("id", "score", *extra), keys, "inner"))


def composite_sentiment(posts: DataFrame, scores: DataFrame, sentiments: DataFrame,
                        as_of: int, retention_days: int = P.RETENTION_DAYS,
                        min_body: int = P.MIN_BODY_ANALYSED,
                        align_to: int | None = None,
                        join_on: list[str] | None = None) -> DataFrame:
    """Q-1: id, subreddit, created, score, sentiment_value, sentiment_composite.

    Both joins are on ``id``: Spark hash-partitions the post side once and the
    second join reuses that partitioning (one exchange per input, none after).
    ``join_on=["id"]`` is for inputs bucketed by ``id`` (no exchange at all).
    """
    recent = recent_posts(posts, as_of, retention_days, min_body, align_to)
    cut = retention_cutoff(as_of, retention_days, align_to)
    scores, sentiments = since_date(scores, cut), since_date(sentiments, cut)
    keys = join_on or join_keys(recent, scores, sentiments)
    extra = [k for k in keys if k != "id"]
    ps = post_scores(recent, scores, keys)
    joined = ps.join(sentiments.select("id", "sentiment_value", *extra), keys, "inner")
    return joined.select(
        "id", "subreddit", "created", "score", "sentiment_value",
        composite("sentiment_value", "score").alias("sentiment_composite"), *extra)
