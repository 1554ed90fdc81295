"""Q-7: one ingest batch of polled posts (FIL-3, PRJ-5, SNK-3..5, AGG-6)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import content_hash
from moodcast.operators import text as T
from moodcast.operators.upsert import latest_per_key, upsert_posts, upsert_rows, upsert_scores
from moodcast.schemas import POST_FIELDS, SCORE_METRICS


def scoring_gate(posts: DataFrame, min_title: int = P.GATE_MIN_TITLE,
                 min_body: int = P.GATE_MIN_BODY) -> DataFrame:
    """FIL-3: body present, title_length >= 10, selftext_length >= 100."""
    return posts.filter(F.col("selftext").isNotNull() &
                        (F.col("title_length") >= F.lit(min_title)) &
                        (F.col("selftext_length") >= F.lit(min_body)))


Scorer = Callable[[DataFrame, list], DataFrame]


def lexicon_scorer(lexicon: DataFrame, rules: T.Rules = T.FULL) -> Scorer:
    """The default scorer: (id, text, carry...) -> (id, sentiment, carry...)."""
    def score(df: DataFrame, carry: list) -> DataFrame:
        return T.text_sentiment(df, "id", "text", lexicon, rules, carry=carry)
    return score


def sentiment_todo(stored: DataFrame, batch: DataFrame, version: str = P.SCORER_VERSION,
                   order: str | None = "polled_at") -> tuple[DataFrame, DataFrame]:
    """FIL-10: (gated polls with their hash, keys of the latest polls whose hash is not stored).

    The text is hashed in the scan (FN-9); reducing to the latest poll and the
    anti join on (id, hash) move narrow rows only.
    """
    part = ["dt"] if "dt" in batch.columns else []
    order = order if order and order in batch.columns else None
    g = scoring_gate(batch).select("id", "title", "selftext", *part, *([order] if order else []))
    hashed = g.withColumn("hash_check", content_hash("title", "selftext", version))
    keys = hashed.select("id", "hash_check", *([order] if order else []))
    if order:
        keys = latest_per_key(keys, ["id"], [order])
    return hashed, keys.join(stored.select("id", "hash_check"), ["id", "hash_check"], "left_anti")


def incremental_sentiment(stored: DataFrame, batch: DataFrame, lexicon: DataFrame | None, as_of: int,
                          version: str = P.SCORER_VERSION, rules: T.Rules = T.FULL,
                          order: str | None = "polled_at",
                          scorer: Scorer | None = None,
                          observation=None) -> tuple[DataFrame, DataFrame]:
    """SNK-5: (merged sentiments, rows scored in this batch).

    ``sentiment_todo`` finds the posts to score from hashes; only their text is
    then fetched with a semi join and scored -- the expensive step -- and
    upserted. ``updated_timestamp`` is ``as_of``. ``scorer`` replaces the lexicon
    job, e.g. with a model run as a pandas UDF over Arrow batches; it gets
    ``(id, text, carry...)`` and returns ``(id, sentiment, carry...)``. Give a
    scorer its own ``version`` so a model change re-scores every post.
    """
    part = ["dt"] if "dt" in batch.columns else []
    hashed, keys = sentiment_todo(stored, batch, version, order)
    # null-safe: a poll may lack polled_at, a post its title
    todo = hashed.alias("h").join(keys.alias("k"), reduce(and_, [
        F.col("h.id") == F.col("k.id"), *[F.col(f"h.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys.columns if c != "id"]]),
        "left_semi")
    # a redelivered poll has its row twice; the posts stay where this deals them until they are scored
    todo = (todo.repartition(T.even_tasks(batch), "id").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("hash_check")))
            .filter("_n = 1"))
    score = scorer or lexicon_scorer(lexicon, rules)
    scored = score(todo.select("id", T.post_text("title", "selftext").alias("text"), "hash_check", *part),
                   ["hash_check", *part])
    fresh = scored.select("id", "hash_check", F.lit(int(as_of)).cast("bigint").alias("updated_timestamp"),
                          F.col("sentiment").alias("sentiment_value"), *part)
    if observation is not None:
        fresh = fresh.observe(observation, F.count(F.lit(1)).alias("scored"))
    return upsert_rows(stored, fresh, ["id"]), fresh


class IngestResult:
    """The merged tables and action rows of one batch. Each frame is built on
    first access, so reading only the post upsert plans no text scoring."""

    def __init__(self, batch: DataFrame, posts: DataFrame, scores: DataFrame,
                 sentiments: DataFrame, lexicon: DataFrame, as_of: int, version: str,
                 rules: T.Rules):
        self._args = (batch, posts, scores, sentiments, lexicon, as_of, version, rules)

    @cached_property
    def _sentiment(self):
        batch, _, _, sentiments, lexicon, as_of, version, rules = self._args
        return incremental_sentiment(sentiments, batch, lexicon, as_of, version, rules)

    @cached_property
    def _posts(self):
        batch, posts = self._args[:2]
        fields = [f for f in POST_FIELDS if f in batch.columns and f != "id"]
        fields += ["dt"] if "dt" in batch.columns else []
        return upsert_posts(posts, batch.drop("title", "selftext"), fields)

    @cached_property
    def _scores(self):
        batch, _, scores = self._args[:3]
        part = ["dt"] if "dt" in batch.columns else []
        polls = batch.select("id", F.col("polled_at").alias("timestamp"), *SCORE_METRICS, *part)
        return upsert_scores(scores, polls.dropDuplicates(["id", "timestamp"]))

    posts = property(lambda self: self._posts[0])
    post_actions = property(lambda self: self._posts[1])
    scores = property(lambda self: self._scores[0])
    score_actions = property(lambda self: self._scores[1])
    sentiments = property(lambda self: self._sentiment[0])
    scored = property(lambda self: self._sentiment[1])

    def counts(self) -> DataFrame:
        """AGG-6: (counter, n) -- total, new posts, score changes, sentiment updates."""
        # one aggregation per action frame, then one row per counter
        pa = self.post_actions.agg(F.count(F.lit(1)).alias("total"),
                                   F.count_if(F.col("action") == "new").alias("new_posts"))
        sa = self.score_actions.agg(F.count_if("changed").alias("score_updates"))
        # counted by their hashes: no text is scored for it
        batch, _, _, sentiments, _, _, version, _ = self._args
        sc = sentiment_todo(sentiments, batch, version)[1].agg(F.count(F.lit(1)).alias("sentiment_updates"))

        def long(df, names):
            pairs = ", ".join(f"'{n}', cast({n} as bigint)" for n in names)
            return df.selectExpr(f"stack({len(names)}, {pairs}) as (counter, n)")

        return (long(pa, ["total", "new_posts"]).unionByName(long(sa, ["score_updates"]))
                .unionByName(long(sc, ["sentiment_updates"])))


def ingest(batch: DataFrame, posts: DataFrame, scores: DataFrame, sentiments: DataFrame,
           lexicon: DataFrame, as_of: int, version: str = P.SCORER_VERSION,
           rules: T.Rules = T.FULL) -> IngestResult:
    """Q-7: apply one batch of polled rows (``raw_posts`` schema) to the three
    post tables. Sentiment is computed from the text before the text columns
    are dropped from the post row (PRJ-5)."""
    return IngestResult(batch, posts, scores, sentiments, lexicon, as_of, version, rules)
