"""The hourly analysis job (reference: the batch analyzer), end to end.

composite (one scan + two joins) -> exact hourly sums, staged once in the
shared folder -> hourly table upsert, and daily sums rolled up from the staged
hourly sums (hours nest in days, sums are exact) -> SMA -> daily table upsert.
The composite is computed once, not once per grain; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators.buckets import EXACT_COL, bucket_sums, moving_average, rollup_sums
from moodcast.operators.composite import composite_sentiment, retention_cutoff
from moodcast.operators.upsert import upsert_rows
from moodcast.sources.store import PART, as_store, date_of, merge_into, stage, unstage

KEYS = ["timestamp", "subreddit"]


def analysis_frames(posts: DataFrame, scores: DataFrame, sentiments: DataFrame,
                    p: P.AnalysisParams, staged_hourly: DataFrame | None = None):
    """(hourly, daily-with-SMA) DataFrames for one run."""
    if staged_hourly is not None:
        hourly_exact = staged_hourly
    else:
        comp = composite_sentiment(posts, scores, sentiments, p.as_of, p.retention_days, p.min_body,
                                   align_to=P.DAY if p.align else None)
        hourly_exact = bucket_sums(comp, P.HOUR, keep_exact=True)
    hourly = hourly_exact.drop(EXACT_COL)
    daily = moving_average(rollup_sums(hourly_exact, P.DAY), p.sma_rows)
    if p.align:
        # the first rows-1 days of the window lack SMA history: not written,
        # so the stored values (from runs that had the history) stay
        first = retention_cutoff(p.as_of, p.retention_days, P.DAY) + 1
        daily = daily.filter(F.col("timestamp") >= F.lit(first + (p.sma_rows - 1) * P.DAY))
    return hourly, daily


def _only_dates(df: DataFrame, dates) -> DataFrame:
    return df if dates is None else df.filter(F.col(PART).isin(list(dates)))


def run_analysis(spark: SparkSession, root, p: P.AnalysisParams, run_id: str,
                 dates=None) -> None:
    """One analysis run over the stored post tables.

    ``dates=None`` recomputes the whole retention window (the reference's
    behaviour). With the dates an ingest batch touched (``run_ingest`` returns
    them), only those partitions of the three post tables are read; hourly and
    daily sums of those dates are complete (a bucket never spans two dates), and
    the moving average is recomputed over the small daily table from the first
    touched date on, using the stored rows before it as context.
    """
    store = as_store(root)
    posts = _only_dates(store.read(spark, "submissions", S.SUBMISSIONS), dates)
    scores = _only_dates(store.read(spark, "submission_scores", S.SUBMISSION_SCORES), dates)
    sents = _only_dates(store.read(spark, "submission_sentiments", S.SUBMISSION_SENTIMENTS), dates)
    comp = composite_sentiment(posts, scores, sents, p.as_of, p.retention_days, p.min_body,
                               align_to=P.DAY if p.align else None, join_on=store.join_on())
    staged = stage(spark, bucket_sums(comp, P.HOUR, keep_exact=True), f"hourly_exact_{run_id}")
    hourly, daily = analysis_frames(posts, scores, sents, p, staged)
    merge_into(spark, store, "analyzed_by_created_hours", S.HOURLY,
               hourly.withColumn(PART, date_of("timestamp")),
               lambda stored, u: upsert_rows(stored, u, KEYS), f"hours_{run_id}")
    if dates is None or not store.exists(spark, "analyzed_by_created_days"):
        upd = daily
    else:
        sums = rollup_sums(staged, P.DAY)
        stored = store.read(spark, "analyzed_by_created_days", S.DAILY).drop("sum_sentiment_score_sma", PART)
        combined = moving_average(upsert_rows(stored, sums, KEYS), p.sma_rows)
        first = F.lit(min(dates)).cast("date")
        upd = combined.filter(date_of("timestamp") >= first)
        # staged: the rows are derived from the table about to be rewritten
        upd = stage(spark, upd, f"days_sma_{run_id}")
    merge_into(spark, store, "analyzed_by_created_days", S.DAILY, upd.withColumn(PART, date_of("timestamp")),
               lambda stored, u: upsert_rows(stored, u, KEYS), f"days_{run_id}")
    unstage(spark, staged)
    if upd is not daily:
        unstage(spark, upd)
