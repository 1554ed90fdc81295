"""Keyed upserts as set operations (SNK-1..6), no driver loop.

These return the merged rows; ``moodcast.sources.store`` writes them back to
only the touched partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from moodcast.schemas import SCORE_METRICS


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (in-batch "last write wins").

    ``max_by`` over a struct runs as a partial + final aggregation, so a key
    with many rows is reduced map side.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(keys)
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def upsert_rows(target: DataFrame, updates: DataFrame, keys: list[str],
                observation: Observation | None = None) -> DataFrame:
    """Rows of ``updates`` (unique per key) replace target rows with the same
    key; target rows without an update stay; target columns the update lacks
    keep their stored value (a ``$set`` of the listed fields).

    One full outer join on the keys: each side is read and shuffled once, and
    the update side -- often an expensive plan, e.g. freshly scored text -- is
    evaluated once. An ``observation`` receives ``inserted`` and ``updated``
    counts from the same pass (no extra job).
    """
    ucols = [c for c in updates.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias("_u_" + c) for c in ucols], F.lit(True).alias("_u"))
    t = target.withColumn("_t", F.lit(True)) if observation is not None else target
    j = t.join(u, keys, "full_outer")
    if observation is not None:
        j = j.observe(observation,
                      F.count_if(F.col("_u") & F.col("_t").isNull()).alias("inserted"),
                      F.count_if(F.col("_u") & F.col("_t").isNotNull()).alias("updated"))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in ucols:
            out.append(F.when(F.col("_u"), F.col("_u_" + c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def _differs(a: list[Column], b: list[Column]) -> Column:
    """FIL-9: any field differs, NULL equal to NULL."""
    return reduce(lambda x, y: x | y, [~x.eqNullSafe(y) for x, y in zip(a, b)])


def change_runs(stored: DataFrame, batch: DataFrame, key: str, order: str,
                fields: list[str]) -> DataFrame:
    """Replay ``batch`` snapshots on ``stored`` rows, one key at a time.

    Returns every row of stored (``_src`` 0, first) and batch (``_src`` 1) of the
    touched keys with ``_chg``: true when its ``fields`` differ from the row
    before it (the first row of a key always "changes"). Sequential semantics:
    an unchanged snapshot equals the state, so comparing with the predecessor
    is comparing with the state. Only stored rows of keys in the batch are read
    (semi join), and the window holds one key's snapshots -- one per poll.
    """
    # a semi join needs no distinct keys on its right side
    s = stored.join(batch.select(key), key, "left_semi").withColumn("_src", F.lit(0))
    b = batch.withColumn("_src", F.lit(1))
    u = s.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_src", order)
    prev = [F.lag(F.col(f)).over(w) for f in fields]
    first = F.row_number().over(w) == 1
    return u.withColumn("_chg", first | _differs([F.col(f) for f in fields], prev))


def upsert_scores(stored: DataFrame, batch: DataFrame, metrics=SCORE_METRICS,
                  time_col: str = "timestamp",
                  observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-4: (merged table, batch rows with ``changed``).

    A key's final row is its last row whose metrics differ from the row before
    it, so ``timestamp`` is the start of the latest run of equal metrics
    (A@1, B@2, B@3 -> B@2); an unchanged re-poll leaves the stored row.
    """
    cols = ["id", time_col, *metrics]
    if "dt" in batch.columns and "dt" in stored.columns:
        cols.append("dt")  # the post's partition; constant per id
    runs = change_runs(stored.select(*cols), batch.select(*cols), "id", time_col, list(metrics))
    if observation is not None:
        # batch rows that change a score (inserts included), counted by the write
        runs = runs.observe(observation,
                            F.count_if(F.col("_chg") & (F.col("_src") == 1)).alias("changed"))
    last = latest_per_key(runs.filter("_chg").select(*cols, "_src"), ["id"], ["_src", time_col])
    merged = upsert_rows(stored.select(*cols), last.select(*cols), ["id"])
    actions = runs.filter(F.col("_src") == 1).select("id", time_col, F.col("_chg").alias("changed"))
    return merged, actions


def upsert_posts(stored: DataFrame, batch: DataFrame, fields: list[str],
                 order: str = "polled_at",
                 observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-3: (merged table, batch rows with ``action`` new / changed / same).

    Each snapshot overlays the listed ``fields``; columns the batch lacks keep
    their stored value; a NULL in the batch overwrites.
    """
    fields = [f for f in fields if f != "id"]
    # a redelivered poll row (same id and poll time) is one snapshot
    b = batch.select("id", *fields, order).dropDuplicates(["id", order])
    runs = change_runs(stored.select("id", *fields), b, "id", order, fields)
    has_stored = F.max(F.when(F.col("_src") == 0, 1).otherwise(0)).over(Window.partitionBy("id"))
    runs = runs.withColumn("_stored", has_stored == 1)
    last = latest_per_key(b, ["id"], [order]).drop(order)
    merged = upsert_rows(stored, last, ["id"], observation)
    first_new = (~F.col("_stored")) & (F.row_number().over(
        Window.partitionBy("id").orderBy("_src", order)) == 1)
    actions = runs.filter(F.col("_src") == 1).select(
        "id", order,
        F.when(first_new, F.lit("new")).when(F.col("_chg"), F.lit("changed"))
         .otherwise(F.lit("same")).alias("action"))
    return merged, actions
