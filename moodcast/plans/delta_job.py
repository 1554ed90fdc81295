"""The incremental analysis job: result tables kept by signed deltas of the posts that a batch touched.

Reads of the post tables and of the contributions are cut to the touched dates
(partitions) and posts (semi join) before any other join; sums are read and written
in the touched partitions only. Each step can be repeated: a state row
remembers the run that changed it last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.composite import composite_sentiment, retention_cutoff
from moodcast.operators.deltas import (KEYS, apply_deltas, contributions, restated_average, rollup, shown, signed_deltas)
from moodcast.sources.store import PART, as_store, date_of, merge_into, stage, unstage

CONTRIBUTIONS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("created", T.LongType()), T.StructField("subreddit", T.StringType()),
    T.StructField("value", T.DecimalType(18, 9))])
STATE = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("subreddit", T.StringType()), T.StructField("exact", T.DecimalType(28, 9)),
    T.StructField("n_values", T.LongType()), T.StructField("n_posts", T.LongType()), T.StructField("run", T.StringType())])


def touched_contributions(spark: SparkSession, root, p: P.AnalysisParams, touched: DataFrame, dates: list) -> tuple[DataFrame, DataFrame]:
    """(before, after): stored and present contributions of the touched posts (``id``, ``dt``)."""
    store = as_store(root)

    def mine(df: DataFrame) -> DataFrame:
        return df.filter(F.col(PART).isin(dates)).join(touched, ["id", PART], "left_semi")

    after = contributions(composite_sentiment(
        *(mine(store.read(spark, n, s)) for n, s in (
            ("submissions", S.SUBMISSIONS), ("submission_scores", S.SUBMISSION_SCORES), ("submission_sentiments", S.SUBMISSION_SENTIMENTS))),
        p.as_of, p.retention_days, p.min_body, join_on=["id", PART]))
    if not store.exists(spark, "contributions"):
        return after.limit(0), after
    # a post that left the window is in no run any more: its buckets stay as they are
    cut = retention_cutoff(p.as_of, p.retention_days)
    return mine(store.read(spark, "contributions", CONTRIBUTIONS)).where(F.col("created") > cut), after


def run_delta(spark: SparkSession, root, p: P.AnalysisParams, touched: DataFrame, run_id: str) -> None:
    """Bring hour and day results up to date after a batch that touched the posts ``touched`` (``id``, ``dt``).

    ``run_id`` names the run and is not used twice but to retry it. The
    collected dates are bounded by the calendar span of the batch.
    """
    store = as_store(root)
    posts = stage(spark, touched.select("id", PART).distinct(), f"touched_{run_id}")
    dates = sorted(r[PART] for r in posts.select(PART).distinct().collect())
    before, after = touched_contributions(spark, root, p, posts, dates)
    now = stage(spark, after, f"after_{run_id}")
    hours = stage(spark, signed_deltas(before, now, P.HOUR).withColumn(PART, date_of("timestamp")), f"delta_{run_id}")
    days = rollup(hours, P.DAY).withColumn(PART, date_of("timestamp"))
    for name, deltas in (("hourly_state", hours), ("daily_state", days)):
        merge_into(spark, store, name, STATE, deltas, lambda stored, u: apply_deltas(stored, u, run_id), f"{name}_{run_id}")

    def upsert(stored: DataFrame, u: DataFrame) -> DataFrame:
        return stored.join(u, KEYS, "left_anti").unionByName(u.where("_shown").drop("_shown"))

    changed = store.read(spark, "hourly_state", STATE).filter(F.col(PART).isin(dates)).where(F.col("run") == run_id)
    gone = changed.where("n_posts = 0").select(*KEYS, F.lit(None).cast("double").alias("sum_sentiment_score"), PART)
    merge_into(spark, store, "analyzed_by_created_hours", S.HOURLY,
               shown(changed).withColumn("_shown", F.lit(True)).unionByName(gone.withColumn("_shown", F.lit(False))),
               upsert, f"delta_hours_{run_id}", dates)
    # days of the communities that changed: one row a day
    daily = store.read(spark, "daily_state", STATE)
    theirs = daily.join(daily.where(F.col("run") == run_id).select("subreddit"), "subreddit", "left_semi")
    new = restated_average(theirs, F.col("run") == run_id, p.sma_rows).withColumn("_shown", F.lit(True))
    gone = daily.where((F.col("run") == run_id) & (F.col("n_posts") == 0)).select(
        *KEYS, *[F.lit(None).cast("double").alias(c) for c in ("sum_sentiment_score", "sum_sentiment_score_sma")], PART)
    merge_into(spark, store, "analyzed_by_created_days", S.DAILY, new.unionByName(gone.withColumn("_shown", F.lit(False))),
               upsert, f"delta_days_{run_id}")
    # last, so that a retry finds the old contributions until the sums are right
    merge_into(spark, store, "contributions", CONTRIBUTIONS, now,
               lambda stored, u: stored.join(posts, ["id", PART], "left_anti").unionByName(u), f"contributions_{run_id}", dates)
    for t in (posts, now, hours):
        unstage(spark, t)
