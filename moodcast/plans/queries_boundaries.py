"""Registered queries: learned sentence boundaries (TXT-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodcast.operators import text as T
from moodcast.operators.boundaries import learned_abbreviations, learned_sentences, learned_starters, token_counts
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.registry import register
from moodcast.sources.store import stage

# abbreviations put into the given texts: "vs." for a word that is frequent, "e.g." for another
_SWAPS = ((" with ", " vs. "), (" by ", " e.g. "))
_TEXT = "selftext"
for _old, _new in _SWAPS:
    _TEXT = f"replace({_TEXT}, '{_old}', '{_new}')"


def _bare(t: str) -> str:
    return f"regexp_replace(lower({t}), '^([^a-z0-9.])+|([^a-z0-9.])+$', '', 'g')"


_STEM = r"regexp_replace({}, '\.+$', '')"
_LEARN = [
    ("texts", f"select id, title || chr(10) || {_TEXT} txt from raw_posts"),
    ("lines", r"select id, l, unnest(string_split(regexp_replace(txt, '[\t\r\f ]+', ' ', 'g'), chr(10))) line, "
              r"unnest(range(len(string_split(regexp_replace(txt, '[\t\r\f ]+', ' ', 'g'), chr(10))))) line_no from (select *, 1 l from texts) x"),
    ("toks", "select id, line_no, list_filter(string_split(trim(line, ' '), ' '), lambda t: t <> '') ts from lines"),
    ("pairs", f"select {_bare('ts[i]')} tok, {_bare("coalesce(ts[i + 1], '')")} nxt from "
              "(select ts, unnest(generate_series(1, len(ts))) i from toks) y"),
    ("counts", f"select {_STEM.format('tok')} \"type\", ends_with(tok, '.') period, case when ends_with(tok, '.') then "
               f"{_STEM.format('nxt')} end nxt, count(*) n from pairs where regexp_matches(tok, '[a-z0-9]') group by 1, 2, 3"),
    ("whole", "select sum(n) all_n, sum(case when period then n else 0 end) all_p from counts"),
    ("abbr", """
select "type", n, n_period, score from (
  select *, -2 * ((n_period * ln(all_p / all_n) + (n - n_period) * ln(1 - all_p / all_n))
      - (n_period * ln(0.99::double) + (n - n_period) * ln(1 - 0.99::double)))
    * exp(-len0) * (length("type") - len0 + 1) * pow(len0, -(n - n_period)) score
  from (select *, cast(length(replace("type", '.', '')) as double) len0, cast(all_p0 as double) all_p, cast(all_n0 as double) all_n
        from (select "type", cast(sum(n) as bigint) n, cast(sum(case when period then n else 0 end) as bigint) n_period
              from counts where regexp_matches("type", '[a-z]') group by 1) g,
             (select all_n all_n0, all_p all_p0 from whole) w where n_period > 0) h) k
where score >= 0.3"""),
]
_K, _A, _N, _ALL = "n_after", "after_n", "word_n", "words_n"


def _log_likelihood(hits: str, tries: str, rate: str) -> str:
    return (f"(case when {hits} > 0 then {hits} * ln({rate}) else 0 end"
            f" + case when {tries} - {hits} > 0 then ({tries} - {hits}) * ln(1 - {rate}) else 0 end)")


_ONE, _IN, _OUT = f"({_N} / {_ALL})", f"({_K} / {_A})", f"(({_N} - {_K}) / ({_ALL} - {_A}))"
_REST = f"({_N} - {_K})", f"({_ALL} - {_A})"
_SPLIT = _LEARN + [
    ("after_stop", """
select nxt word, cast(sum(n) as double) n_after from counts
where period and nxt <> '' and "type" not in (select "type" from abbr) group by 1"""),
    ("candidates", """
select a.word, a.n_after, w.word_n, (select cast(sum(n) as double) from counts) words_n,
  (select sum(n_after) from after_stop) after_n
from after_stop a join (select "type", cast(sum(n) as double) word_n from counts group by 1) w on a.word = w."type" """),
    ("starters", f"""
select word from candidates where {_K} <= {_A} and {_N} >= {_K} and {_ALL} > {_A} and {_IN} > {_ONE}
  and -2 * ({_log_likelihood(_K, _A, _ONE)} + {_log_likelihood(*_REST, _ONE)}
            - {_log_likelihood(_K, _A, _IN)} - {_log_likelihood(*_REST, _OUT)}) > 30"""),
    ("cut", r"""
select id, line_no, string_split(regexp_replace(line, '([.!?]+[\])''"]*) ', '\1' || chr(10), 'g'), chr(10)) ps from lines"""),
    ("parts", """
select *, row_number() over (partition by id order by line_no, i) "at" from (
  select id, line_no, i, trim(ps[i], ' ') part from (select *, unnest(generate_series(1, len(ps))) i from cut) x) y
where part <> ''"""),
    ("ends", f"""
select *, {_bare("string_split(part, ' ')[-1]")} last_token, string_split(part, ' ')[1] first_token from parts"""),
    ("known", f"""
select *, coalesce(ends_with(last_token, '.') and {_STEM.format('last_token')} in (select "type" from abbr), false) abbreviated,
  coalesce(regexp_matches(first_token, '^[^a-zA-Z0-9]*[A-Z]')
           and {_STEM.format(_bare('first_token'))} in (select word from starters), false) starts
from ends"""),
    ("opened", """
select *, case when lag(abbreviated) over w and not starts and lag(line_no) over w = line_no then 0 else 1 end opens
from known window w as (partition by id order by "at")"""),
    ("joined", """
select id, s, string_agg(part, ' ' order by "at") sentence
from (select *, sum(opens) over (partition by id order by "at") s from opened) z group by id, s"""),
]


def _texts(fx):
    body = F.col("selftext")
    for old, new in _SWAPS:
        body = F.replace(body, F.lit(old), F.lit(new))
    return fx.raw_posts().select("id", T.post_text("title", body).alias("text")).repartition(
        fx.spark.sparkContext.defaultParallelism, "id")


def _counts(fx, texts):
    """The token counts, which every later step reads: staged, so that the texts are counted once."""
    return stage(fx.spark, token_counts(texts), "query_tokens")


@register("q_learned_abbreviations", with_fixtures(
    'select "type", n, n_period, round(score, 6) score from abbr', ["raw_posts"], _LEARN))
def q_learned_abbreviations(fx):
    """Types that carry a final period as an abbreviation does."""
    found = learned_abbreviations(_counts(fx, _texts(fx)))
    return found.select("type", "n", "n_period", F.round("score", 6).alias("score"))


@register("q_learned_sentences", with_fixtures("""
select id, cast(row_number() over (partition by id order by s) - 1 as int) sent_idx, sentence
from joined where regexp_matches(sentence, '[^.!? ]')""", ["raw_posts"], _SPLIT))
def q_learned_sentences(fx):
    """Sentences of the texts, split with the learned abbreviations and starters."""
    texts = _texts(fx)
    counts = _counts(fx, texts)
    abbreviations = learned_abbreviations(counts)
    return learned_sentences(texts, "id", "text", abbreviations, learned_starters(counts, abbreviations))
