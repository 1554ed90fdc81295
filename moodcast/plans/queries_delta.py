"""Registered queries: sums kept by signed deltas equal sums over all posts (AGG-1, AGG-2, WIN-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.operators.composite import composite_sentiment, retention_cutoff
from moodcast.operators.deltas import (KEYS, apply_deltas, contributions, restated_average, rollup, shown, signed_deltas)
from moodcast.operators.history import history_of, latest_scores, splice
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.queries_core import bucket_sql, sma_sql
from moodcast.plans.registry import register
from moodcast.schemas import SCORE_METRICS
from moodcast.sources.fixtures import AS_OF

DAYS = 3650   # all posts
_COMP = f"""
select p.id, p.subreddit, p.created, s.score, t.sentiment_value,
  cast(cast(t.sentiment_value * (case when s.score > 0 then ln(s.score) else 0.0 end)
    as {P.COMPOSITE_DECIMAL}) as double) sentiment_composite
from submissions p join latest s on p.id = s.id join submission_sentiments t on p.id = t.id
where p.created > {retention_cutoff(AS_OF, DAYS)} and p.selftext_length > {P.MIN_BODY_ANALYSED}"""
# the score row of a post after all polls: the first poll of the last run of equal metrics; only its score matters here
_LATEST = """
select id, score from (select * from scores_old union all select * from scores_new) x
qualify row_number() over (partition by id order by "timestamp" desc) = 1"""
_VIEWS = ["submissions", "scores_old", "scores_new", "submission_sentiments"]


def _states(fx) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hour state, day state before, day deltas): sums over the stored scores, then the polls' deltas."""
    metrics = list(SCORE_METRICS)
    stored = fx.scores_old().select("id", "timestamp", *metrics)
    polls = fx.scores_new().select("id", "timestamp", *metrics)
    scores = latest_scores(splice(history_of(stored), polls))
    changed = polls.select("id")

    def mine(df: DataFrame) -> DataFrame:
        return df.join(changed, "id", "left_semi")

    before = contributions(composite_sentiment(fx.submissions(), stored, fx.sentiments(), AS_OF, DAYS))
    after = contributions(composite_sentiment(mine(fx.submissions()), mine(scores), mine(fx.sentiments()), AS_OF, DAYS))
    none = before.limit(0)
    hours = apply_deltas(signed_deltas(none, before, P.HOUR).withColumn("run", F.lit("first")), signed_deltas(mine(before), after, P.HOUR), "second")
    days = rollup(signed_deltas(none, before, P.HOUR), P.DAY).withColumn("run", F.lit("first"))
    return hours, days, rollup(signed_deltas(mine(before), after, P.HOUR), P.DAY)


@register("q_delta_hours", with_fixtures(bucket_sql(P.HOUR), _VIEWS, [("latest", _LATEST), ("composite", _COMP)]))
def q_delta_hours(fx):
    """Hour sums after the polls' deltas."""
    return shown(_states(fx)[0])


@register("q_delta_days", with_fixtures(sma_sql("days"), _VIEWS, [("latest", _LATEST), ("composite", _COMP), ("days", bucket_sql(P.DAY))]))
def q_delta_days(fx):
    """Day sums and moving average: the rows that the deltas restate, and the others as they were."""
    _, days, deltas = _states(fx)
    old = restated_average(days, F.lit(True))
    new = restated_average(apply_deltas(days, deltas, "second"), F.col("run") == "second")
    return new.unionByName(old.join(new, KEYS, "left_anti"))
