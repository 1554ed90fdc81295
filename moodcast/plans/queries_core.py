"""Registered queries for scans, the composite, bucket sums and the SMA."""

from __future__ import annotations

from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.buckets import bucket_sums, moving_average
from moodcast.operators.composite import composite_sentiment, post_scores, recent_posts, retention_cutoff
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.registry import register
from moodcast.sources.fixtures import AS_OF, RETENTION_DAYS
from moodcast.sources.tables import conform

CUT = retention_cutoff(AS_OF, RETENTION_DAYS)


def _composite(fx):
    return composite_sentiment(fx.submissions(), fx.scores(), fx.sentiments(),
                               as_of=AS_OF, retention_days=RETENTION_DAYS)


# ---- scans (SRC-1..3): declared schema, missing columns read as NULL -------

@register("q_scan_submissions", with_fixtures("""
select id, subreddit, title_length, hide_score, created, author_fullname, selftext_length,
  post_hint, url from submissions""", ["submissions"]))
def q_scan_submissions(fx):
    return conform(fx.submissions(), S.SUBMISSIONS)


@register("q_scan_scores", with_fixtures("""
select id, "timestamp", upvote_ratio, ups, score, num_comments from submission_scores""",
                                         ["submission_scores"]))
def q_scan_scores(fx):
    return conform(fx.scores(), S.SUBMISSION_SCORES)


@register("q_scan_sentiments", with_fixtures("""
select id, cast(null as varchar) hash_check, updated_timestamp, sentiment_value
from submission_sentiments""", ["submission_sentiments"]))
def q_scan_sentiments(fx):
    return conform(fx.sentiments(), S.SUBMISSION_SENTIMENTS)


# ---- filters and joins ------------------------------------------------------

@register("q_recent_posts", with_fixtures(f"""
select * from submissions where created > {CUT} and selftext_length > {P.MIN_BODY_ANALYSED}""",
                                          ["submissions"]))
def q_recent_posts(fx):
    return recent_posts(fx.submissions(), AS_OF, RETENTION_DAYS)


@register("q_post_scores", with_fixtures(f"""
select p.id, p.subreddit, p.created, s.score
from submissions p join submission_scores s on p.id = s.id
where p.created > {CUT} and p.selftext_length > {P.MIN_BODY_ANALYSED}""",
                                         ["submissions", "submission_scores"]))
def q_post_scores(fx):
    return post_scores(recent_posts(fx.submissions(), AS_OF, RETENTION_DAYS), fx.scores())


COMPOSITE_SQL = f"""
select p.id, p.subreddit, p.created, s.score, t.sentiment_value,
  cast(cast(t.sentiment_value * (case when s.score > 0 then ln(s.score) else 0.0 end)
    as {P.COMPOSITE_DECIMAL}) as double) sentiment_composite
from submissions p
join submission_scores s on p.id = s.id
join submission_sentiments t on p.id = t.id
where p.created > {CUT} and p.selftext_length > {P.MIN_BODY_ANALYSED}"""
COMPOSITE_VIEWS = ["submissions", "submission_scores", "submission_sentiments"]


@register("q_composite", with_fixtures(COMPOSITE_SQL, COMPOSITE_VIEWS))
def q_composite(fx):
    return _composite(fx)


def bucket_sql(seconds: int) -> str:
    return f"""
select cast(floor(created / {float(seconds)}) * {seconds} as bigint) "timestamp", subreddit,
  cast(sum(cast(sentiment_composite as {P.COMPOSITE_DECIMAL})) as double) sum_sentiment_score
from composite group by 1, 2"""


@register("q_hourly_sums", with_fixtures(bucket_sql(P.HOUR), COMPOSITE_VIEWS,
                                         [("composite", COMPOSITE_SQL)]))
def q_hourly_sums(fx):
    return bucket_sums(_composite(fx), P.HOUR)


@register("q_daily_sums", with_fixtures(bucket_sql(P.DAY), COMPOSITE_VIEWS,
                                        [("composite", COMPOSITE_SQL)]))
def q_daily_sums(fx):
    return bucket_sums(_composite(fx), P.DAY)


def sma_sql(source: str, rows: int = P.SMA_ROWS) -> str:
    return f"""
select "timestamp", subreddit, sum_sentiment_score,
  cast(sum(cast(sum_sentiment_score as decimal(38,9))) over w as double)
    / count(sum_sentiment_score) over w sum_sentiment_score_sma
from {source}
window w as (partition by subreddit order by "timestamp" rows between {rows - 1} preceding and current row)"""


DAILY_SMA_SQL = with_fixtures(sma_sql("daily"), COMPOSITE_VIEWS,
                              [("composite", COMPOSITE_SQL), ("daily", bucket_sql(P.DAY))])


@register("q_daily_sma", DAILY_SMA_SQL)
def q_daily_sma(fx):
    return moving_average(bucket_sums(_composite(fx), P.DAY))


@register("q_daily_rollup", DAILY_SMA_SQL)
def q_daily_rollup(fx):
    """Daily sums rolled up from exact hourly sums (the analysis job's path)."""
    from moodcast.operators.buckets import rollup_sums
    return moving_average(rollup_sums(bucket_sums(_composite(fx), P.HOUR, keep_exact=True), P.DAY))


@register("q_window_hourly", with_fixtures(bucket_sql(P.HOUR), COMPOSITE_VIEWS,
                                           [("composite", COMPOSITE_SQL)]))
def q_window_hourly(fx):
    """The streaming hourly aggregation (window + watermark) run as a batch."""
    from moodcast.streaming.jobs import hourly_stream
    return hourly_stream(_composite(fx))
