"""Reading stored tables (SRC-1..6).

Tables are Parquet directories, partitioned by ``dt`` (the UTC date of the
post's ``created``) where the writer put one. Reads always use the declared
schema: nothing is inferred, and a column missing from old files reads as NULL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodcast import schemas as S


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               partition_col: str | None = "dt") -> DataFrame:
    """SRC-1..3: ``spark.read.schema(...)`` of a stored table.

    A ``dt`` partition column is kept when present so later filters on it
    prune directories.
    """
    fields = list(schema.fields)
    if partition_col and _has_partition(spark, path, partition_col):
        fields.append(T.StructField(partition_col, T.DateType(), True))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _has_partition(spark: SparkSession, path: str, col: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().startswith(col + "=") for s in fs.listStatus(p))


def conform(df: DataFrame, schema: T.StructType, keep: tuple = ("dt",)) -> DataFrame:
    """Project ``df`` onto ``schema``: cast each field, absent ones become NULL."""
    have = set(df.columns)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in have
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    cols += [F.col(k) for k in keep if k in have and k not in schema.fieldNames()]
    return df.select(*cols)


def time_range(df: DataFrame, start: int, end: int, col: str | None = "timestamp") -> DataFrame:
    """FIL-4: half-open ``[start, end)`` on an epoch column.

    When the table carries ``dt`` the matching date range is added as well,
    which Spark turns into partition pruning. ``col=None`` applies only the
    date range (for tables that carry the post's ``dt`` but not its time).
    """
    out = df
    if col is not None:
        c = F.col(col)
        out = df.filter((c >= F.lit(int(start))) & (c < F.lit(int(end))))
    if "dt" in df.columns:
        lo = F.date_from_unix_date(F.lit(int(start) // 86400))
        hi = F.date_from_unix_date(F.lit((int(end) - 1) // 86400))
        out = out.filter((F.col("dt") >= lo) & (F.col("dt") <= hi))
    return out


def bucket_range(buckets: DataFrame, start: int, end: int) -> DataFrame:
    """SRC-4 + SRT-1: range scan of a result table, ordered by time then community."""
    cols = [c for c in ("timestamp", "subreddit", "sum_sentiment_score",
                        "sum_sentiment_score_sma") if c in buckets.columns]
    return time_range(buckets, start, end).select(*cols).orderBy("timestamp", "subreddit")


def price_range(prices: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """SRC-5 + FIL-5: one price series in a range, ordered by time."""
    return (time_range(prices, start, end).filter(F.col("name") == F.lit(name))
            .select("timestamp", "name", "value").orderBy("timestamp"))


def read_landed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed poll snapshots (one JSON object per line, or Parquet) read with
    the declared ``raw_posts`` schema: an attribute a post lacks (author,
    body, hint, URL) reads as NULL (PRJ-4); lengths missing from the source
    are derived (PRJ-3)."""
    from moodcast.functions.exprs import text_length

    df = spark.read.schema(S.RAW_POSTS).format(fmt).load(path)
    return df.withColumns({
        "selftext_length": F.coalesce(F.col("selftext_length"), text_length("selftext")),
        "title_length": F.coalesce(F.col("title_length"), text_length("title")),
    })


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's test tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


STORED = {
    "submissions": S.SUBMISSIONS,
    "submission_scores": S.SUBMISSION_SCORES,
    "submission_sentiments": S.SUBMISSION_SENTIMENTS,
    "analyzed_by_created_hours": S.HOURLY,
    "analyzed_by_created_days": S.DAILY,
    "finance_indexes": S.FINANCE_INDEXES,
}
