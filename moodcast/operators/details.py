"""Q-6: per-post details of one community and bucket (SRC-6, JOIN-3/4, FN-3..5, FN-10/11, SRT-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import (abs_sentiment, absolute_url, details_composite, effect,
                                      local_label, round_half_up, time_bucket, url_slug)
from moodcast.operators.joins import join_keys
from moodcast.sources.tables import time_range

WIDTH = {"hour": P.HOUR, "day": P.DAY}
LABEL_FORMAT = {"hour": "yyyy-MM-dd HH'h'", "day": "yyyy-MM-dd"}
CREATED_FORMAT = "yyyy-MM-dd HH:mm:ss"

DETAIL_COLUMNS = ("id", "subreddit", "created", "url", "slug", "selftext_length",
                  "upvote_ratio", "ups", "score", "num_comments", "sentiment_value",
                  "composite_sentiment", "abs_sentiment", "effect")


def bucket_width(kind: str) -> int:
    """FIL-11: only 'hour' and 'day' are valid bucket kinds."""
    if kind not in WIDTH:
        raise ValueError(f"invalid chart type: {kind!r}")
    return WIDTH[kind]


def chart_label(kind: str, bucket, tz: str = "UTC"):
    """FN-16: 'Hour 2024-01-05 13h' / 'Day 2024-01-05' as a column."""
    bucket_width(kind)
    b = F.lit(int(bucket)) if isinstance(bucket, int) else (
        F.col(bucket) if isinstance(bucket, str) else bucket)
    return F.concat(F.lit(kind.capitalize() + " "), local_label(b, LABEL_FORMAT[kind], tz))


def post_details(posts: DataFrame, scores: DataFrame, sentiments: DataFrame,
                 kind: str, community: str | None = None, bucket: int | None = None,
                 tz: str = "UTC", base: str = P.URL_BASE,
                 join_on: list[str] | None = None) -> DataFrame:
    """Details rows, strongest effect first.

    With ``community`` and ``bucket`` this is the reference's page for one
    bucket (the filters prune to a tiny post set before the two lookups);
    without them every post gets its row plus its ``bucket`` column.
    Lookups are left joins (the N+1 lookups of the reference become two joins):
    a post without a score or sentiment keeps NULLs and composite 0.
    """
    w = bucket_width(kind)
    p = posts
    if bucket is not None:
        p = time_range(p, int(bucket), int(bucket) + w, col="created")
    if community is not None:
        p = p.filter(F.col("subreddit") == F.lit(community))
    if bucket is not None:
        # the lookups only need the partitions of this bucket's posts
        scores = time_range(scores, int(bucket), int(bucket) + w, col=None)
        sentiments = time_range(sentiments, int(bucket), int(bucket) + w, col=None)
    keys = join_on or join_keys(p, scores, sentiments)
    extra = [k for k in keys if k != "id"]
    j = (p.select("id", "subreddit", "created", "url", "selftext_length", *extra)
         .join(scores.select("id", "upvote_ratio", "ups", "score", "num_comments", *extra), keys, "left")
         .join(sentiments.select("id", "sentiment_value", *extra), keys, "left"))
    comp = details_composite("sentiment_value", "score")
    full_url = absolute_url("url", base)
    out = j.select(
        "id", "subreddit",
        local_label("created", CREATED_FORMAT, tz).alias("created"),
        full_url.alias("url"),
        url_slug(full_url).alias("slug"),
        "selftext_length", "upvote_ratio", "ups", "score", "num_comments",
        round_half_up("sentiment_value", 3).alias("sentiment_value"),
        comp.alias("composite_sentiment"),
        abs_sentiment(comp).alias("abs_sentiment"),
        effect(comp).alias("effect"),
        *([] if bucket is not None else [time_bucket("created", w).alias("bucket")]))
    if bucket is None:
        # whole-table variant: no global sort (a page sorts its own bucket)
        return out
    return out.orderBy(F.desc("abs_sentiment"), F.col("id"))


def details_title(kind: str, bucket, community, tz: str = "UTC"):
    """FN-16: 'Details for <label> of <community>' as a column. ``bucket`` is
    an epoch, a column name or a Column; ``community`` a name or a Column."""
    comm = community if isinstance(community, Column) else F.lit(community)
    return F.concat(F.lit("Details for "), chart_label(kind, bucket, tz), F.lit(" of "), comm)
