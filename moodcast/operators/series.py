"""Q-4 / Q-5: chart series over a time range, scaled price indexes (FN-6..8, SET-1, AGG-3, AGG-7)."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import round_half_up, scale_0_10, series_visible
from moodcast.sources.tables import time_range


def day_range(as_of: int, tz: str = "UTC", days: int = P.DISPLAY_DAY) -> tuple[int, int]:
    """[local midnight - days, local midnight): today is excluded."""
    now = datetime.fromtimestamp(int(as_of), ZoneInfo(tz))
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    start = (today.replace(tzinfo=None) - timedelta(days=days)).replace(tzinfo=ZoneInfo(tz))
    return int(start.timestamp()), int(today.timestamp())


def hour_range(as_of: int, tz: str = "UTC", hours: int = P.DISPLAY_HOUR) -> tuple[int, int]:
    """[now - hours, start of the current local hour)."""
    now = datetime.fromtimestamp(int(as_of), ZoneInfo(tz))
    current_hour = now.replace(minute=0, second=0, microsecond=0)
    start = (now.replace(tzinfo=None) - timedelta(hours=hours)).replace(tzinfo=ZoneInfo(tz))
    return int(start.timestamp()), int(current_hour.timestamp())


def sentiment_series(buckets: DataFrame, start: int, end: int, use_sma: bool) -> DataFrame:
    """(series, timestamp, value, tooltip) of a result table in [start, end).

    FN-8: the SMA or the plain sum by flag, a missing value reads 0 (the hourly
    table has no SMA column, so the flag there gives zeros).
    """
    col = "sum_sentiment_score_sma" if use_sma else "sum_sentiment_score"
    v = F.coalesce(F.col(col), F.lit(0.0)) if col in buckets.columns else F.lit(0.0)
    return time_range(buckets, start, end).select(
        F.col("subreddit").alias("series"), "timestamp", v.alias("value"),
        round_half_up(v, 2).alias("tooltip"))


def scaled_prices(prices: DataFrame, start: int, end: int,
                  names=P.PRICE_SERIES, suffix: str = P.PRICE_KEY_SUFFIX) -> DataFrame:
    """FN-6 + AGG-3 + FIL-6: each price series min-max scaled to 0..10 in range.

    Min and max come from a grouped aggregate (partial + final, so a long
    series never lands whole in one task); the result has one row per listed
    name, a proven bound, so it is broadcast back. Constant series -> NULL.
    """
    p = time_range(prices, start, end).filter(
        F.col("name").isin(list(names)) & F.col("value").isNotNull())
    stats = p.groupBy("name").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    return p.join(F.broadcast(stats), "name").select(
        F.concat(F.col("name"), F.lit(suffix)).alias("series"), "timestamp",
        scale_0_10("value", "_mn", "_mx").alias("value"),
        round_half_up("value", 2).alias("tooltip"))


def chart_series(buckets: DataFrame, start: int, end: int, use_sma: bool,
                 prices: DataFrame | None = None, names=P.PRICE_SERIES,
                 visible=P.DEFAULT_VISIBLE) -> DataFrame:
    """Q-4: sentiment series, plus price series for the day chart (SET-1), and
    FIL-8's default-visible flag."""
    s = sentiment_series(buckets, start, end, use_sma)
    if prices is not None:
        s = s.unionByName(scaled_prices(prices, start, end, names))
    return s.withColumn("visible", series_visible("series", visible))


def series_arrays(series: DataFrame) -> DataFrame:
    """AGG-7: one ordered point list per series (chart payload).

    Bounded by the chart range (38 days or 24 hours per series), which the
    caller applies first; the list is built with partial aggregation.
    """
    pts = F.struct("timestamp", "value", "tooltip")
    return series.groupBy("series").agg(
        F.sort_array(F.collect_list(pts)).alias("points"),
        F.max(F.col("visible").cast("int")).cast("boolean").alias("visible"))
