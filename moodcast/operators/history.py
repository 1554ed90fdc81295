"""Score history: run-length intervals of equal metrics that take late polls (SNK-4, STR-1).

A run holds the consecutive polls of one post that found equal metrics: when the
first and the last of them were taken, all poll times, and the metrics once. A
batch is spliced in by its poll times, not by its arrival: a late poll lengthens
a run, starts one, or splits one in two. The history is a function of the set of
polls, so any order and any split into batches gives the same rows, and the
latest run of a post is its score row.

Two polls of one post at one time are one poll; if their metrics differ, the greater
ones (compared in order, NULL first) stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from moodcast.schemas import SCORE_METRICS


def history_of(scores: DataFrame, metrics=SCORE_METRICS, time_col: str = "timestamp") -> DataFrame:
    """Score rows (one poll each) as a history: to begin one from a stored score table."""
    part = [c for c in ("dt",) if c in scores.columns]
    return scores.select("id", time_col, F.col(time_col).alias("until"), F.array(time_col).alias("polls"), *metrics, *part)


def splice(history: DataFrame, polls: DataFrame, metrics=SCORE_METRICS, time_col: str = "timestamp",
           observation: Observation | None = None) -> DataFrame:
    """``history`` with all ``polls`` (id, time, metrics) in it.

    Runs of posts that are not polled pass as they are. Those of the others are
    laid out as points (one for each poll), joined by the batch's points, and cut
    into runs again where the metrics differ from the poll before: partial aggregates by
    (id, time), then one window and one aggregate by id, which share their
    shuffle. A window holds one post's polls. An ``observation`` receives
    ``changed``: polls of the batch, not known before, that begin a run.
    """
    metrics = list(metrics)
    part = [c for c in ("dt",) if c in history.columns and c in polls.columns]
    cols = ["id", time_col, "until", "polls", *metrics, *part]
    ids = polls.select("id", *part)
    touched, rest = (history.select(*cols).join(ids, ["id", *part], how) for how in ("left_semi", "left_anti"))
    values = F.struct(*metrics)
    old = touched.select("id", *part, F.explode("polls").alias("_t"), values.alias("_m"), F.lit(0).alias("_new"))
    new = polls.select("id", *part, F.col(time_col).alias("_t"), values.alias("_m"), F.lit(1).alias("_new"))
    points = old.unionByName(new).groupBy("id", *part, "_t").agg(F.max("_m").alias("_m"), F.min("_new").alias("_new"))
    by_time = Window.partitionBy("id", *part).orderBy("_t")
    before = F.lag("_m").over(by_time)
    begins = F.row_number().over(by_time).eqNullSafe(1) | ~F.col("_m").eqNullSafe(before)
    cut = points.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(by_time))
    runs = cut.groupBy("id", *part, "_run").agg(
        F.min("_t").alias(time_col), F.max("_t").alias("until"), F.sort_array(F.collect_list("_t")).alias("polls"),
        F.first("_m").alias("_m"), F.max(F.col("_begins") * F.col("_new")).alias("_fresh"))
    if observation is not None:
        runs = runs.observe(observation, F.sum("_fresh").alias("changed"))
    return runs.select("id", time_col, "until", "polls", *[F.col(f"_m.{m}").alias(m) for m in metrics], *part).unionByName(rest)


def latest_scores(history: DataFrame, metrics=SCORE_METRICS, time_col: str = "timestamp") -> DataFrame:
    """The score row of each post: its latest run, dated by the run's first poll."""
    part = [c for c in ("dt",) if c in history.columns]
    last = F.max_by(F.struct(time_col, *metrics), time_col).alias("_last")
    return history.groupBy("id", *part).agg(last).select("id", "_last.*", *part)


def newest_polls(batch: DataFrame, history: DataFrame, time_col: str = "polled_at") -> DataFrame:
    """Rows of ``batch`` that are the newest poll of their post; ``history`` holds the batch already."""
    part = [c for c in ("dt",) if c in history.columns and c in batch.columns]
    last = history.groupBy("id", *part).agg(F.max("until").alias(time_col))
    return batch.join(last, ["id", *part, time_col], "left_semi")
