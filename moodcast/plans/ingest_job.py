"""The ingest job (reference: the 20-minute crawler run) on stored tables.

One batch of polled rows -> four touched-partition merges. Each merge is
idempotent, so replaying a batch (a restarted stream, a retried job) leaves
the tables as one application would. Polls may come late: the score history
takes them at their own time, score rows are its latest runs, and post rows and texts
follow the newest poll of a post, whichever batch brings it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast import schemas as S
from moodcast.operators import text as T
from moodcast.operators.ingest import Scorer, incremental_sentiment
from moodcast.operators.history import history_of, latest_scores, newest_polls, splice
from moodcast.operators.memo import memo_version, sentence_refs, sentiment_from_memo, unseen_polarities
from moodcast.operators.upsert import upsert_posts, upsert_rows
from moodcast.sources.store import TableStore, as_store, merge_into, stage, unstage, with_dt, write_table
from moodcast.sources.tables import conform

TABLES = {
    "submissions": S.SUBMISSIONS,
    "submission_scores": S.SUBMISSION_SCORES,
    "score_history": S.SCORE_HISTORY,
    "submission_sentiments": S.SUBMISSION_SENTIMENTS,
}


@dataclass
class IngestReport:
    """What one batch did: the post dates it touched (an incremental analysis
    run takes them as ``dates``) and the reference's run counters, observed
    on the merge writes themselves (``Observation``), not by extra passes."""

    dates: list
    counts: dict


def memo_scorer(spark: SparkSession, store: TableStore, lexicon: DataFrame, rules: T.Rules,
                as_of: int, tag: str, scratch: list[DataFrame]) -> Scorer:
    """A scorer that looks sentences up in ``sentence_memo`` and appends those it lacks.

    Polarities depend on nothing but their key, so a retry that appends a row
    again changes no result. The rows lie under the date of ``as_of``. Staged
    tables are put into ``scratch`` for the caller to remove.
    """
    version = memo_version(lexicon, rules)

    def score(df: DataFrame, carry: list) -> DataFrame:
        refs = stage(spark, sentence_refs(df, "id", "text", carry), f"refs_{tag}")
        stored = (store.read(spark, "sentence_memo", S.SENTENCE_MEMO) if store.exists(spark, "sentence_memo")
                  else spark.createDataFrame([], S.SENTENCE_MEMO))
        fresh = unseen_polarities(df, "text", refs, lexicon, stored, version, rules)
        fresh = stage(spark, with_dt(fresh.withColumn("_as_of", F.lit(int(as_of))), "_as_of").drop("_as_of"), f"memo_{tag}")
        write_table(fresh, store.path("sentence_memo"), mode="append")
        scratch.extend([refs, fresh])
        return sentiment_from_memo(refs, store.read(spark, "sentence_memo", S.SENTENCE_MEMO), version, carry)

    return score


def run_ingest(spark: SparkSession, root, batch: DataFrame, lexicon: DataFrame,
               as_of: int, batch_id: str, version: str = P.SCORER_VERSION,
               rules: T.Rules = T.FULL, memo: bool = False) -> IngestReport:
    """Apply one batch to the three post tables.

    With ``memo`` the polarities of sentences are kept in ``sentence_memo`` and
    only sentences it lacks are scored (``memo_scorer``); results are the same.

    Rows without an id or a creation time (such as malformed landed lines) are
    set aside and counted as ``rejected``. A poll without a time counts as taken
    when its post was created.
    """
    polled = conform(batch, S.RAW_POSTS).withColumn("polled_at", F.coalesce("polled_at", "created"))
    raw = stage(spark, with_dt(polled, "created"), f"batch_{batch_id}")
    whole = F.col("id").isNotNull() & F.col("created").isNotNull()
    b = raw.filter(whole)   # read three times: from the staged table
    per_date = {r["dt"]: r["n"] for r in b.groupBy("dt").agg(F.count("*").alias("n")).collect()}
    dates, rejected = sorted(per_date), raw.filter(~whole).count()

    store = as_store(root)
    obs = {k: Observation(f"{k}_{batch_id}_{uuid.uuid4().hex[:8]}")
           for k in ("sentiments", "posts", "scores")}
    if not store.exists(spark, "score_history") and store.exists(spark, "submission_scores"):
        # tables from before the history: each score row is one poll
        store.create(history_of(store.read(spark, "submission_scores", S.SUBMISSION_SCORES)), "score_history")
    polls = b.selectExpr("id", "polled_at as timestamp", *S.SCORE_METRICS, "dt")
    merge_into(spark, store, "score_history", S.SCORE_HISTORY, polls,
               lambda stored, u: splice(stored, u, observation=obs["scores"]), f"history_{batch_id}", dates)
    history = store.read(spark, "score_history", S.SCORE_HISTORY).filter(F.col("dt").isin(dates)).join(
        b.select("id", "dt"), ["id", "dt"], "left_semi")
    b = newest_polls(b, history)
    scratch: list[DataFrame] = []
    scorer = memo_scorer(spark, store, lexicon, rules, as_of, batch_id, scratch) if memo else None
    merge_into(
        spark, store, "submission_sentiments", S.SUBMISSION_SENTIMENTS, b,
        lambda stored, u: incremental_sentiment(stored, u, lexicon, as_of, version, rules,
                                                scorer=scorer, observation=obs["sentiments"])[0],
        f"sentiments_{batch_id}", dates)
    for table in scratch:
        unstage(spark, table)
    fields = [f for f in S.POST_FIELDS if f != "id"] + ["dt"]
    merge_into(
        spark, store, "submissions", S.SUBMISSIONS, b,
        lambda stored, u: upsert_posts(stored, u.drop("title", "selftext"), fields,
                                       observation=obs["posts"])[0],
        f"posts_{batch_id}", dates)
    merge_into(
        spark, store, "submission_scores", S.SUBMISSION_SCORES, latest_scores(history),
        lambda stored, u: upsert_rows(stored, u, ["id"]), f"scores_{batch_id}", dates)
    unstage(spark, raw)
    counts = {"total": sum(per_date.values()), "rejected": rejected,
              "new_posts": obs["posts"].get.get("inserted", 0),
              "score_updates": obs["scores"].get.get("changed", 0),
              "sentiment_updates": obs["sentiments"].get.get("scored", 0)}
    return IngestReport(dates, counts)
