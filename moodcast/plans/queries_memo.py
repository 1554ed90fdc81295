"""Registered queries: sentiment through the memo of sentence polarities (TXT-2, TXT-3, SNK-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodcast.operators import text as T
from moodcast.operators.memo import sentence_refs, sentiment_from_memo, unseen_polarities
from moodcast.plans.queries_text import text_sql
from moodcast.plans.registry import register
from moodcast.schemas import SENTENCE_MEMO
from moodcast.sources.fixtures import SCORED_BEFORE
from moodcast.sources.store import stage

_VERSION = "v1"


def _posts(fx):
    return fx.raw_posts().withColumn("text", T.post_text("title", "selftext"))


def _staged_run(fx):
    """As the ingest job does it: (staged refs of all posts, memo of a run over the older posts, rows to append)."""
    posts, version = _posts(fx), _VERSION
    tasks = T.even_tasks(posts)
    older = posts.where(F.col("created") < SCORED_BEFORE)
    none = fx.spark.createDataFrame([], SENTENCE_MEMO)
    refs = stage(fx.spark, sentence_refs(posts, "id", "text", carry=["created"], spread=tasks), "query_refs")
    memo = stage(fx.spark, unseen_polarities(older, "text", refs.where(F.col("created") < SCORED_BEFORE), fx.lexicon(),
                                             none, version, spread=tasks), "query_memo")
    return refs, memo, unseen_polarities(posts, "text", refs, fx.lexicon(), memo, version, spread=tasks)


@register("q_memo_sentiment", text_sql("select * from doc_scores", T.FULL))
def q_memo_sentiment(fx):
    """Sentiment of every post: known sentences looked up, the others scored."""
    refs, memo, fresh = _staged_run(fx)
    fresh = stage(fx.spark, fresh, "query_fresh")   # looked up twice, scored once
    return sentiment_from_memo(refs, memo.unionByName(fresh), _VERSION)


@register("q_memo_unseen", text_sql(f"""
select sha256(s.sentence) hash, max(x.polarity) polarity
from sents s join sent_scores x on s.id = x.id and s.sent_idx = x.sent_idx join raw_posts p on p.id = s.id
group by 1 having min(p.created) >= {SCORED_BEFORE}""", T.FULL))
def q_memo_unseen(fx):
    """The sentences that no older post holds: the rows a run appends."""
    return _staged_run(fx)[2].select(F.lower(F.hex("hash")).alias("hash"), "polarity")
