"""Declared schemas of the stored tables (nothing is inferred on read)."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_POSTS = _struct(
    ("id", _S), ("subreddit", _S), ("title", _S), ("hide_score", _B), ("created", _L),
    ("author_fullname", _S), ("selftext", _S), ("post_hint", _S), ("url", _S),
    ("selftext_length", _I), ("title_length", _I), ("upvote_ratio", _D), ("ups", _I),
    ("score", _I), ("num_comments", _I), ("polled_at", _L))

SUBMISSIONS = _struct(
    ("id", _S), ("subreddit", _S), ("title_length", _I), ("hide_score", _B), ("created", _L),
    ("author_fullname", _S), ("selftext_length", _I), ("post_hint", _S), ("url", _S))

SUBMISSION_SCORES = _struct(
    ("id", _S), ("timestamp", _L), ("upvote_ratio", _D), ("ups", _I), ("score", _I),
    ("num_comments", _I))

# runs of equal metrics with the times of their polls (operators/history.py)
SCORE_HISTORY = T.StructType([
    *SUBMISSION_SCORES.fields[:2], T.StructField("until", _L, True), T.StructField("polls", T.ArrayType(_L), True),
    *SUBMISSION_SCORES.fields[2:]])

SUBMISSION_SENTIMENTS = _struct(
    ("id", _S), ("hash_check", _S), ("updated_timestamp", _L), ("sentiment_value", _D))

# polarities by content (operators/memo.py)
SENTENCE_MEMO = _struct(("version", _S), ("hash", T.BinaryType()), ("polarity", _D))

HOURLY = _struct(("timestamp", _L), ("subreddit", _S), ("sum_sentiment_score", _D))

DAILY = _struct(("timestamp", _L), ("subreddit", _S), ("sum_sentiment_score", _D),
                ("sum_sentiment_score_sma", _D))

FINANCE_INDEXES = _struct(("timestamp", _L), ("name", _S), ("value", _D))

PRICE_PAGES = _struct(("page_id", _S), ("name", _S), ("html", _S))

LEXICON = _struct(("word", _S), ("valence", _D))

SCORE_METRICS = ("upvote_ratio", "ups", "score", "num_comments")
POST_FIELDS = tuple(f.name for f in SUBMISSIONS.fields)
