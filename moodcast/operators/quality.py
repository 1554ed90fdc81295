"""Q-9 freshness alerts and DQ-2 key checks (AGG-5, FN-17, TOP-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import is_stale

# The alert texts of the three freshness rules, in rule order.
MSG_POSTS = "No new posts. Submissions are too old."
MSG_DAYS = "analyzed_by_created_days is not updated for a long time."
MSG_HOURS = "analyzed_by_created_hours is not updated for a long time."


def newest(df: DataFrame, col: str) -> DataFrame:
    """AGG-5 / TOP-2: one-row ``max`` (partial per partition, then final); NULL if empty."""
    return df.agg(F.max(F.col(col)).cast("bigint").alias("newest"))


def freshness(posts: DataFrame, days: DataFrame, hours: DataFrame, as_of: int,
              limits=(P.FRESHNESS_POSTS_S, P.FRESHNESS_DAYS_S, P.FRESHNESS_HOURS_S)) -> DataFrame:
    """Q-9: (check, newest, limit_seconds, stale, message) -- one row per rule.

    A rule is stale when its table is empty or its newest row is older than
    ``as_of - limit`` (strict); ``message`` is set only for stale rules.
    """
    rules = [("submissions", posts, "created", limits[0], MSG_POSTS),
             ("analyzed_by_created_days", days, "timestamp", limits[1], MSG_DAYS),
             ("analyzed_by_created_hours", hours, "timestamp", limits[2], MSG_HOURS)]
    rows = []
    for name, df, col, limit, msg in rules:
        stale = is_stale("newest", as_of, limit)
        rows.append(newest(df, col).select(
            F.lit(name).alias("check"), "newest", F.lit(int(limit)).cast("bigint").alias("limit_seconds"),
            stale.alias("stale"), F.when(stale, F.lit(msg)).alias("message")))
    return reduce(DataFrame.unionByName, rows)


def newest_recent_first(df: DataFrame, col: str, as_of: int, limit_s: int) -> DataFrame:
    """AGG-5 on a ``dt``-partitioned table without a full scan in the normal case.

    The max over the partitions from ``date(as_of - limit)`` on is the exact
    newest value whenever the table is fresh; only when those partitions are
    empty (an alert case) the whole table is scanned. One one-row action.
    """
    if "dt" not in df.columns:
        return newest(df, col)
    first = F.date_from_unix_date(F.lit((int(as_of) - int(limit_s)) // P.DAY))
    recent = newest(df.filter(F.col("dt") >= first), col).first()[0]
    if recent is not None:
        return df.sparkSession.createDataFrame([(int(recent),)], "newest bigint")
    return newest(df, col)


def freshness_stored(posts: DataFrame, days: DataFrame, hours: DataFrame, as_of: int,
                     limits=(P.FRESHNESS_POSTS_S, P.FRESHNESS_DAYS_S, P.FRESHNESS_HOURS_S)) -> DataFrame:
    """Q-9 on stored, ``dt``-partitioned tables: same rows as ``freshness``,
    reading only recent partitions while the tables are fresh."""
    spark = posts.sparkSession

    def one(df, col, limit):
        v = newest_recent_first(df, col, as_of, limit).first()[0]
        return spark.createDataFrame([(v,)], f"{col} bigint")

    return freshness(one(posts, "created", limits[0]), one(days, "timestamp", limits[1]),
                     one(hours, "timestamp", limits[2]), as_of, limits)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-2: keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def key_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """DQ-2 summary: per table, rows, distinct keys, duplicated keys and rows.

    One grouped count per table (partial aggregation absorbs hot keys), then
    a global sum over the per-key counts.
    """
    out = []
    for name, (df, keys) in tables.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        out.append(per_key.agg(
            F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
            F.count(F.lit(1)).cast("bigint").alias("n_keys"),
            F.count_if(F.col("c") > 1).cast("bigint").alias("n_duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("bigint")
             .alias("n_duplicate_rows"),
        ).select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*"))
    return reduce(DataFrame.unionByName, out)
