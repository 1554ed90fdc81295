"""Registered queries for the read side: chart series, details, quality, top-N."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import epoch_point, time_bucket
from moodcast.operators.buckets import bucket_sums, moving_average, rollup_sums
from moodcast.operators.details import chart_label, details_title, post_details
from moodcast.operators.newest import newest_n
from moodcast.operators.quality import MSG_DAYS, MSG_HOURS, MSG_POSTS, freshness, key_report
from moodcast.operators.series import (chart_series, day_range, hour_range, scaled_prices,
                                       series_arrays)
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.queries_core import (COMPOSITE_SQL, COMPOSITE_VIEWS, _composite, bucket_sql,
                                         sma_sql)
from moodcast.plans.registry import register
from moodcast.sources.fixtures import AS_OF
from moodcast.sources.tables import bucket_range, price_range

DAY_START, DAY_END = day_range(AS_OF, "UTC", P.DISPLAY_DAY)
HOUR_START, HOUR_END = hour_range(AS_OF, "UTC", P.DISPLAY_HOUR)
DETAILS_COMMUNITY = "click"
DETAILS_BUCKET = 1705276800  # 2024-01-15T00:00:00Z, a day bucket

RESULT_CTES = [("composite", COMPOSITE_SQL), ("hourly", bucket_sql(P.HOUR)),
               ("daily_sums", bucket_sql(P.DAY)), ("daily", sma_sql("daily_sums"))]


def _sql(body: str, views=(), result=False, extra=()) -> str:
    names = list(COMPOSITE_VIEWS) + list(views) if result else list(views)
    return with_fixtures(body, names, (RESULT_CTES if result else []) + list(extra))


def _hourly(fx):
    return bucket_sums(_composite(fx), P.HOUR)


def _daily(fx):
    # rolled up from the exact hourly sums, as the analysis job does: equal to
    # direct daily sums, and a plan holding both grains shares the hourly shuffle
    return moving_average(rollup_sums(bucket_sums(_composite(fx), P.HOUR, keep_exact=True), P.DAY))


def rnd(x: str, d: int) -> str:
    return f"cast(round(cast({x} as decimal(38,9)), {d}) as double)"


def local(e: str, fmt: str) -> str:
    return f"strftime(make_timestamp(({e}) * 1000000), '{fmt}')"


# ---- range scans ------------------------------------------------------------

@register("q_bucket_range", _sql(f"""
select "timestamp", subreddit, sum_sentiment_score from hourly
where "timestamp" >= {DAY_START} and "timestamp" < {DAY_END}""", result=True))
def q_bucket_range(fx):
    return bucket_range(_hourly(fx), DAY_START, DAY_END)


@register("q_price_range", _sql(f"""
select "timestamp", name, "value" from finance_indexes
where name = 'nasdaq' and "timestamp" >= {DAY_START} and "timestamp" < {DAY_END}""",
                                ["finance_indexes"]))
def q_price_range(fx):
    return price_range(fx.finance_indexes(), "nasdaq", DAY_START, DAY_END)


PRICE_SCALED_SQL = f"""
select name || '_index' series, "timestamp",
  case when mx > mn then 10.0 * ("value" - mn) / (mx - mn) end "value",
  {rnd('"value"', 2)} tooltip
from (select *, min("value") over (partition by name) mn, max("value") over (partition by name) mx
      from finance_indexes
      where name in ('nasdaq', 'bitcoin') and "value" is not null
        and "timestamp" >= {DAY_START} and "timestamp" < {DAY_END}) p"""


@register("q_price_scaled", _sql(PRICE_SCALED_SQL, ["finance_indexes"]))
def q_price_scaled(fx):
    return scaled_prices(fx.finance_indexes(), DAY_START, DAY_END)


# ---- chart series -----------------------------------------------------------

def _visible(col="series"):
    return f"{col} in ({', '.join(repr(v) for v in P.DEFAULT_VISIBLE)})"


CHART_DAY_SQL = f"""
select series, "timestamp", "value", tooltip, {_visible()} visible from (
  select subreddit series, "timestamp", coalesce(sum_sentiment_score_sma, 0.0) "value",
    {rnd('coalesce(sum_sentiment_score_sma, 0.0)', 2)} tooltip
  from daily where "timestamp" >= {DAY_START} and "timestamp" < {DAY_END}
  union all
  {PRICE_SCALED_SQL}) u"""


@register("q_chart_day", _sql(CHART_DAY_SQL, ["finance_indexes"], result=True))
def q_chart_day(fx):
    return chart_series(_daily(fx), DAY_START, DAY_END, True, fx.finance_indexes())


@register("q_chart_hour", _sql(f"""
select subreddit series, "timestamp", coalesce(sum_sentiment_score, 0.0) "value",
  {rnd('coalesce(sum_sentiment_score, 0.0)', 2)} tooltip, {_visible('subreddit')} visible
from hourly where "timestamp" >= {HOUR_START} and "timestamp" < {HOUR_END}""", result=True))
def q_chart_hour(fx):
    return chart_series(_hourly(fx), HOUR_START, HOUR_END, False)


@register("q_series_arrays", _sql(f"""
select series, visible, cast(row_number() over (partition by series order by "timestamp", "value", tooltip) - 1
  as integer) "position", "timestamp", "value", tooltip from ({CHART_DAY_SQL}) c""", ["finance_indexes"], result=True))
def q_series_arrays(fx):
    """The points of each series' array with their position."""
    arrays = series_arrays(chart_series(_daily(fx), DAY_START, DAY_END, True, fx.finance_indexes()))
    return (arrays.select("series", "visible", F.posexplode("points").alias("position", "point"))
            .select("series", "visible", "position", "point.*"))


@register("q_series_visible", _sql(f"select distinct series, visible from ({CHART_DAY_SQL}) c",
                                   ["finance_indexes"], result=True))
def q_series_visible(fx):
    return (chart_series(_daily(fx), DAY_START, DAY_END, True, fx.finance_indexes())
            .select("series", "visible").distinct())


@register("q_bucket_labels", _sql(f"""
select "timestamp", subreddit,
  'Hour ' || {local('"timestamp"', '%Y-%m-%d %Hh')} hour_label,
  'Day ' || {local('cast(floor("timestamp" / 86400.0) * 86400 as bigint)', '%Y-%m-%d')} day_label,
  make_timestamp("timestamp" * 1000000) point
from hourly""", result=True))
def q_bucket_labels(fx):
    h = _hourly(fx)
    return h.select("timestamp", "subreddit",
                    chart_label("hour", "timestamp").alias("hour_label"),
                    chart_label("day", time_bucket("timestamp", P.DAY)).alias("day_label"),
                    epoch_point("timestamp").alias("point"))


@register("q_details_titles", _sql(f"""
select "timestamp", subreddit,
  'Details for Day ' || {local('"timestamp"', '%Y-%m-%d')} || ' of ' || subreddit title
from daily""", result=True))
def q_details_titles(fx):
    """The details page title for every (community, day) of the daily table."""
    return _daily(fx).select("timestamp", "subreddit",
                             details_title("day", "timestamp", F.col("subreddit")).alias("title"))


# ---- details ----------------------------------------------------------------

def details_sql(where: str, bucket_col: str = "") -> str:
    sv = rnd("t.sentiment_value", 3)
    comp = (f"coalesce(cast(cast({sv} * (case when s.score > 0 then ln(s.score) end) "
            f"as {P.COMPOSITE_DECIMAL}) as double), 0.0)")
    full = f"'{P.URL_BASE}' || p.url"
    path = f"regexp_extract({full}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"""
select id, subreddit, created, url, slug, selftext_length, upvote_ratio, ups, score, num_comments,
  sentiment_value, composite_sentiment, {rnd('abs(composite_sentiment)', 2)} abs_sentiment,
  case when composite_sentiment >= 0 then 'positive' else 'negative' end effect{bucket_col}
from (
  select p.id, p.subreddit, {local('p.created', '%Y-%m-%d %H:%M:%S')} created, {full} url,
    string_split(trim({path}, '/'), '/')[-1] slug, p.selftext_length,
    s.upvote_ratio, s.ups, s.score, s.num_comments, {sv} sentiment_value,
    {comp} composite_sentiment, p.created created_epoch
  from submissions p
  left join submission_scores s on p.id = s.id
  left join submission_sentiments t on p.id = t.id
  where {where}) d"""


DETAIL_VIEWS = ["submissions", "submission_scores", "submission_sentiments"]


@register("q_details", _sql(details_sql(
    f"p.subreddit = '{DETAILS_COMMUNITY}' and p.created >= {DETAILS_BUCKET} "
    f"and p.created < {DETAILS_BUCKET + P.DAY}"), DETAIL_VIEWS))
def q_details(fx):
    return post_details(fx.submissions(), fx.scores(), fx.sentiments(), "day",
                        DETAILS_COMMUNITY, DETAILS_BUCKET)


@register("q_details_all", _sql(details_sql(
    "true", ", cast(floor(created_epoch / 3600.0) * 3600 as bigint) bucket"), DETAIL_VIEWS))
def q_details_all(fx):
    return post_details(fx.submissions(), fx.scores(), fx.sentiments(), "hour")


# ---- data quality -------------------------------------------------------------

def _fresh(name, table, col, limit, msg):
    stale = f"(max({col}) is null or max({col}) < {AS_OF - limit})"
    return (f"select '{name}' \"check\", cast(max({col}) as bigint) newest, "
            f"cast({limit} as bigint) limit_seconds, {stale} stale, "
            f"case when {stale} then '{msg}' end message from {table}")


@register("q_freshness", _sql(" union all ".join([
    _fresh("submissions", "submissions", "created", P.FRESHNESS_POSTS_S, MSG_POSTS),
    _fresh("analyzed_by_created_days", "daily", '"timestamp"', P.FRESHNESS_DAYS_S, MSG_DAYS),
    _fresh("analyzed_by_created_hours", "hourly", '"timestamp"', P.FRESHNESS_HOURS_S, MSG_HOURS)]),
    ["submissions"], result=True))
def q_freshness(fx):
    return freshness(fx.submissions(), _daily(fx), _hourly(fx), AS_OF)


def _keys(name, table, keys):
    k = ", ".join(keys)
    return (f"select '{name}' table_name, '{','.join(k.replace(' ', '').replace(chr(34), '').split(','))}' key_columns, "
            f"cast(coalesce(sum(c), 0) as bigint) n_rows, cast(count(*) as bigint) n_keys, "
            f"cast(count_if(c > 1) as bigint) n_duplicate_keys, "
            f"cast(coalesce(sum(case when c > 1 then c end), 0) as bigint) n_duplicate_rows "
            f"from (select {k}, count(*) c from {table} group by {k}) g")


@register("q_duplicate_keys", _sql(" union all ".join([
    _keys("submissions", "submissions", ["id"]),
    _keys("submission_scores", "submission_scores", ["id"]),
    _keys("submission_sentiments", "submission_sentiments", ["id"]),
    _keys("analyzed_by_created_hours", "hourly", ['"timestamp"', "subreddit"]),
    _keys("analyzed_by_created_days", "daily", ['"timestamp"', "subreddit"]),
    _keys("score_polls", "(select * from scores_old union all select * from scores_new)", ["id"])]),
    ["submissions", "scores_old", "scores_new"], result=True))
def q_duplicate_keys(fx):
    return key_report({
        "submissions": (fx.submissions(), ["id"]),
        "submission_scores": (fx.scores(), ["id"]),
        "submission_sentiments": (fx.sentiments(), ["id"]),
        "analyzed_by_created_hours": (_hourly(fx), ["timestamp", "subreddit"]),
        "analyzed_by_created_days": (_daily(fx), ["timestamp", "subreddit"]),
        "score_polls": (fx.scores_old().unionByName(fx.scores_new()), ["id"]),
    })


# ---- newest N -----------------------------------------------------------------

@register("q_newest_n", _sql(f"""
select *, cast(row_number() over (partition by subreddit order by created desc, id) as int) "rank"
from submissions qualify "rank" <= {P.NEWEST_N}""", ["submissions"]))
def q_newest_n(fx):
    return newest_n(fx.submissions(), P.NEWEST_N)


_POLLED = ", ".join(f"'{c}'" for c in P.COMMUNITIES)


@register("q_newest_polled", _sql(f"""
select *, cast(row_number() over (partition by subreddit order by created desc, id) as int) "rank"
from polled_posts where subreddit in ({_POLLED}) qualify "rank" <= {P.NEWEST_N}""",
                                  ["submissions", "polled_posts"]))
def q_newest_polled(fx):
    return newest_n(fx.polled_posts(), P.NEWEST_N, communities=P.COMMUNITIES)
