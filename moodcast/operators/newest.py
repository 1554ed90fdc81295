"""TOP-1 / SRC-7: newest N posts per community."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodcast import params as P

SALTS = 32


def newest_n(posts: DataFrame, n: int = P.NEWEST_N, by: str = "subreddit",
             order: str = "created", communities=None) -> DataFrame:
    """Rows ranked 1..n by ``order`` descending (ties by id) within ``by``.

    ``communities`` (e.g. ``params.COMMUNITIES``, the polled list) restricts
    the groups first; the filter reaches the scan.

    Two levels: the first keeps n rows of each (community, hash of the id), so a
    community holding nearly all posts is spread over ``SALTS`` tasks, and the
    second ranks at most ``SALTS`` x n rows of each. ``row_number() <= n`` is
    planned as a window group limit: each map task keeps only its top n before
    the shuffle.
    """
    if communities is not None:
        posts = posts.filter(F.col(by).isin(list(communities)))
    newest_first = [F.col(order).desc(), F.col("id").asc()]
    part = Window.partitionBy(by, "_salt").orderBy(*newest_first)
    posts = (posts.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
             .withColumn("_rank", F.row_number().over(part))
             .filter(F.col("_rank") <= F.lit(int(n))).drop("_salt", "_rank"))
    w = Window.partitionBy(by).orderBy(*newest_first)
    return (posts.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= F.lit(int(n))))
