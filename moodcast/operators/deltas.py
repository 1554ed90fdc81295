"""Incremental maintenance of the hour and day sums by signed deltas (AGG-1, AGG-2, WIN-1).

Each post's contribution (its composite as an exact decimal) is kept. When polls
change posts, the old contributions of these posts go out and the new ones come
in: signed decimals, summed by bucket, are added to the stored sums. Decimals are
exact, so sums kept this way equal sums over all posts. Posts and buckets that did
not change are not read for it; the moving average is restated for the changed
rows and the ``rows - 1`` after them.

A state row counts its posts and its non-NULL values besides the exact sum: a
bucket without values has a NULL sum, one without posts is no longer shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import time_bucket
from moodcast.operators.buckets import moving_average

KEYS = ["timestamp", "subreddit"]
EXACT = "decimal(28,9)"   # sums of two stay within 38 digits, so no digit is rounded away


def contributions(composite: DataFrame) -> DataFrame:
    """(id, created, subreddit, value[, dt]): what each post adds to its buckets."""
    part = [c for c in ("dt",) if c in composite.columns]
    return composite.select("id", "created", "subreddit", F.col("sentiment_composite").cast(P.COMPOSITE_DECIMAL).alias("value"), *part)


def signed_deltas(before: DataFrame, after: DataFrame, seconds: int) -> DataFrame:
    """(timestamp, subreddit, exact, n_values, n_posts): new minus old contributions of the changed posts, by bucket.

    One partial and final aggregate over both sides; buckets whose change is nil are left out.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        value = F.coalesce(F.col("value"), F.lit(0)).cast(EXACT)
        return df.select(time_bucket("created", seconds).alias("timestamp"), "subreddit", (-value if sign < 0 else value).cast(EXACT).alias("exact"),
                         (F.col("value").isNotNull().cast("long") * sign).alias("n_values"), F.lit(sign).cast("long").alias("n_posts"))

    return rollup(side(before, -1).unionAll(side(after, 1)), None).where("exact <> 0 or n_values <> 0 or n_posts <> 0")


def rollup(deltas: DataFrame, seconds: int | None) -> DataFrame:
    """Deltas summed by key, in coarser buckets if ``seconds`` is given (hours nest in days)."""
    at = F.col("timestamp") if seconds is None else time_bucket("timestamp", seconds)
    return deltas.groupBy(at.alias("timestamp"), "subreddit").agg(
        F.sum("exact").cast(EXACT).alias("exact"), F.sum("n_values").alias("n_values"), F.sum("n_posts").alias("n_posts"))


def apply_deltas(state: DataFrame, deltas: DataFrame, run_id: str) -> DataFrame:
    """``state`` with the deltas of run ``run_id`` added, each row marked with the last run that changed it.

    A row that this run changed before (a retry) stays as it is.
    """
    part = [c for c in ("dt",) if c in state.columns]
    d = deltas.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in ("exact", "n_values", "n_posts")], *[F.col(c).alias(f"_{c}") for c in part])
    j = state.join(d, KEYS, "full_outer")
    adds = F.col("_n_posts").isNotNull() & ~F.col("run").eqNullSafe(run_id)

    def total(c: str, kind: str) -> Column:
        return F.when(adds, F.coalesce(F.col(c), F.lit(0)) + F.col(f"_{c}")).otherwise(F.col(c)).cast(kind).alias(c)

    return j.select(*KEYS, total("exact", EXACT), total("n_values", "long"), total("n_posts", "long"),
                    F.when(adds, F.lit(run_id)).otherwise(F.col("run")).alias("run"),
                    *[F.coalesce(c, f"_{c}").alias(c) for c in part])


def shown(state: DataFrame) -> DataFrame:
    """(timestamp, subreddit, sum_sentiment_score[, dt]) of the state rows that have posts."""
    part = [c for c in ("dt",) if c in state.columns]
    return state.where("n_posts > 0").select(
        *KEYS, F.when(F.col("n_values") > 0, F.col("exact").cast("double")).alias("sum_sentiment_score"), *part)


def restated_average(state: DataFrame, changed: Column, rows: int = P.SMA_ROWS) -> DataFrame:
    """Rows of a day state whose moving average may be new: the changed ones and the ``rows - 1`` after each.

    The windows hold one community's days. A row without posts (all went out) has
    no average itself, but its going changes those after it.
    """
    live = (F.col("n_posts") > 0).cast("int")
    by_time = Window.partitionBy("subreddit").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    counted = state.withColumn("_at", F.sum(live).over(by_time)).withColumn(
        "_last", F.last(F.when(changed, F.col("_at")), ignorenulls=True).over(by_time))
    marked = counted.where("n_posts > 0").withColumn("_new", F.coalesce(F.col("_at") - F.col("_last") < rows, F.lit(False)))
    sums = marked.withColumn("sum_sentiment_score", F.when(F.col("n_values") > 0, F.col("exact").cast("double")))
    part = [c for c in ("dt",) if c in state.columns]
    return moving_average(sums, rows).where("_new").select(*KEYS, "sum_sentiment_score", "sum_sentiment_score_sma", *part)
