"""Registered query: phrases of a lexicon table found in the posts (TXT-5)."""

from __future__ import annotations

from moodcast.operators import text as T
from moodcast.operators.phrases import phrase_matches
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.queries_text import POSTS_TEXT, text_ctes
from moodcast.plans.registry import register

_PHRASES = [
    ("bench_words", r"""
select list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N} ]+', '', 'g'), ' '), lambda w: length(w) > 1) w
from benchmark"""),
    ("bench_runs", """
select distinct array_to_string(w[i:i + n - 1], ' ') phrase, n
from (select w, n, unnest(generate_series(1, len(w) - n + 1)) i from bench_words, (values (1), (2), (3), (5)) l(n)) x"""),
    ("phrases", "select phrase, n, cast(length(phrase) % 9 - 4 as double) / 2 valence from bench_runs"),
    ("runs", """
select id, sent_idx, j - 1 pos, n, lower(array_to_string(toks[j:j + n - 1], ' ')) phrase
from (select *, unnest(generate_series(1, len(toks) - n + 1)) j from words, (values (1), (2), (3), (5)) l(n)) x"""),
]


@register("q_phrase_matches", with_fixtures("""
select r.id, r.sent_idx, cast(r.pos as int) pos, cast(r.n as int) n_words, r.phrase, p.valence
from runs r join phrases p on r.phrase = p.phrase and r.n = p.n
qualify row_number() over (partition by r.id, r.sent_idx, r.pos order by r.n desc) = 1""", ["raw_posts"],
    [POSTS_TEXT] + text_ctes(T.BASE)[:4] + _PHRASES))
def q_phrase_matches(fx):
    """The longest phrase of the lexicon at each token of each post."""
    posts = fx.raw_posts().withColumn("text", T.post_text("title", "selftext"))
    sents = T.sentences(posts, "id", "text", spread=fx.spark.sparkContext.defaultParallelism)
    return phrase_matches(sents, fx.phrase_lexicon())
