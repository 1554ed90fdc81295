"""Q-2 / Q-3: per-bucket sums and the moving average (FN-1, AGG-1/2, WIN-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import time_bucket

EXACT_COL = "_sum_exact"


def bucket_sums(composite: DataFrame, seconds: int, value_col: str = "sentiment_composite",
                keep_exact: bool = False) -> DataFrame:
    """(timestamp, subreddit, sum_sentiment_score) per UTC bucket of ``seconds``.

    Addends are rounded to a fixed decimal before the sum, so the result is the
    same whatever order rows arrive in; the aggregation runs partial (map side)
    then final, which absorbs a community holding most rows.
    """
    exact = F.sum(F.col(value_col).cast(P.COMPOSITE_DECIMAL))
    out = (composite.groupBy(time_bucket("created", seconds).alias("timestamp"), "subreddit")
           .agg(exact.alias(EXACT_COL)))
    out = out.withColumn("sum_sentiment_score", F.col(EXACT_COL).cast("double"))
    return out if keep_exact else out.drop(EXACT_COL)


def rollup_sums(fine: DataFrame, seconds: int) -> DataFrame:
    """Coarser buckets from finer exact sums (hours nest in days): equal to a
    direct ``bucket_sums`` because the sums are exact decimals."""
    out = (fine.groupBy(time_bucket("timestamp", seconds).alias("timestamp"), "subreddit")
           .agg(F.sum(EXACT_COL).alias(EXACT_COL)))
    return out.withColumn("sum_sentiment_score", F.col(EXACT_COL).cast("double")).drop(EXACT_COL)


def moving_average(sums: DataFrame, rows: int = P.SMA_ROWS,
                   value_col: str = "sum_sentiment_score",
                   out_col: str = "sum_sentiment_score_sma") -> DataFrame:
    """WIN-1: mean of the last ``rows`` rows per community (rows, not days).

    Computed as an exact windowed sum divided by the count of non-NULL values,
    which equals ``avg`` and is independent of frame evaluation order. Runs on
    the aggregated table (one row per community and day), so the shuffle by
    community moves few rows.
    """
    w = Window.partitionBy("subreddit").orderBy("timestamp").rowsBetween(-(rows - 1), 0)
    v = F.col(value_col).cast("decimal(38,9)")
    return sums.withColumn(out_col, F.try_divide(F.sum(v).over(w).cast("double"),
                                                 F.count(v).over(w)))
