"""Registered queries for the write side: price extraction, upserts, ingest."""

from __future__ import annotations



from moodcast import params as P
from moodcast.operators import text as T
from moodcast.operators.buckets import bucket_sums, moving_average
from moodcast.operators.composite import composite_sentiment, retention_cutoff
from moodcast.operators.ingest import incremental_sentiment, ingest
from moodcast.operators.upsert import latest_per_key, upsert_rows, upsert_scores
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.queries_core import bucket_sql, sma_sql
from moodcast.plans.queries_text import text_ctes
from moodcast.plans.registry import register
from moodcast.sources.fixtures import AS_OF
from moodcast.sources.prices import (CELL_ATTR_RE, CELL_RE, REAL_VALUE_RE, ROW_A_RE, ROW_RE,
                                     TAG_RE, TBODY_RE, AFTER_BOX_RE, EDGE_SPACE_RE,
                                     extract_prices, extract_prices_a, extract_prices_b)

# Older history (30 days) is in the stored result tables; a run recomputes 20.
STORED_DAYS, RUN_DAYS = 30, 20


def _text_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{TAG_RE}', '', 'g'), '{EDGE_SPACE_RE}', '', 'g')"


PRICE_A_SQL = f"""
select page_id, row_idx, "timestamp", name, "value" from (
  select page_id, cast(i - 1 as int) row_idx,
    cast(epoch(try_strptime({_text_sql('cells[1]')}, '%m/%d/%Y')) as bigint) "timestamp",
    'nasdaq' name,
    try_cast(replace({_text_sql('cells[2]')}, ',', '') as double) "value"
  from (select page_id, i, r, regexp_extract_all(r, '{CELL_RE}', 1) cells from (
    select page_id, i, rows[i] r from (
      select page_id, rows, unnest(generate_series(1, len(rows))) i from (
        select page_id, regexp_extract_all(html, '{ROW_A_RE}', 1) rows from price_pages {{where}}) a) b) c
    where contains(r, '<time')) d) e
where "timestamp" is not null and "value" is not null"""

PRICE_B_SQL = f"""
select page_id, row_idx, cast(cast(d as double) as bigint) "timestamp", 'bitcoin' name,
  try_cast(replace(v, ',', '') as double) "value"
from (
  select page_id, cast(i - 1 as int) row_idx,
    regexp_extract(coalesce(attrs[1], ''), '{REAL_VALUE_RE}', 1) d,
    regexp_extract(coalesce(attrs[2], ''), '{REAL_VALUE_RE}', 1) v
  from (select page_id, i, regexp_extract_all(rows[i], '{CELL_ATTR_RE}', 1) attrs from (
    select page_id, rows, unnest(generate_series(1, len(rows))) i from (
      select page_id, flatten(list_transform(
          regexp_extract_all(regexp_extract(html, '{AFTER_BOX_RE}', 1), '{TBODY_RE}', 1),
          lambda b: regexp_extract_all(b, '{ROW_RE}', 1))) rows
      from price_pages {{where}}) a) b) c) e
where d <> '' and v <> '' and try_cast(d as double) is not null
  and try_cast(replace(v, ',', '') as double) is not null"""


@register("q_extract_price_a", with_fixtures(PRICE_A_SQL.format(where=""), ["price_pages"]))
def q_extract_price_a(fx):
    return extract_prices_a(fx.price_pages())


@register("q_extract_price_b", with_fixtures(PRICE_B_SQL.format(where=""), ["price_pages"]))
def q_extract_price_b(fx):
    return extract_prices_b(fx.price_pages())


EXTRACTED_SQL = (PRICE_A_SQL.format(where="where name = 'nasdaq'") + " union all " +
                 PRICE_B_SQL.format(where="where name = 'bitcoin'"))


@register("q_upsert_prices", with_fixtures("""
select "timestamp", name, "value" from finance_indexes f
where not exists (select 1 from batch b where b."timestamp" = f."timestamp" and b.name = f.name)
union all select "timestamp", name, "value" from batch""", ["finance_indexes", "price_pages"],
    [("extracted", EXTRACTED_SQL),
     ("batch", 'select "timestamp", name, "value" from extracted qualify row_number() over '
               '(partition by "timestamp", name order by page_id desc, row_idx desc) = 1')]))
def q_upsert_prices(fx):
    batch = latest_per_key(extract_prices(fx.price_pages()), ["timestamp", "name"],
                           ["page_id", "row_idx"]).select("timestamp", "name", "value")
    return upsert_rows(fx.finance_indexes(), batch, ["timestamp", "name"])


# ---- result-table upserts (SNK-1, SNK-2) -------------------------------------

def _composite_sql(days: int) -> str:
    cut = retention_cutoff(AS_OF, days)
    return f"""
select p.id, p.subreddit, p.created, s.score, t.sentiment_value,
  cast(cast(t.sentiment_value * (case when s.score > 0 then ln(s.score) else 0.0 end)
    as {P.COMPOSITE_DECIMAL}) as double) sentiment_composite
from submissions p join submission_scores s on p.id = s.id join submission_sentiments t on p.id = t.id
where p.created > {cut} and p.selftext_length > {P.MIN_BODY_ANALYSED}"""


def _comp(fx, days):
    return composite_sentiment(fx.submissions(), fx.scores(), fx.sentiments(), AS_OF, days)


VIEWS3 = ["submissions", "submission_scores", "submission_sentiments"]
UPSERT_SQL = """
select * from stored t where not exists
  (select 1 from run u where u."timestamp" = t."timestamp" and u.subreddit = t.subreddit)
union all select * from run"""


@register("q_upsert_hours", with_fixtures(UPSERT_SQL, VIEWS3, [
    ("c_old", _composite_sql(STORED_DAYS)), ("c_new", _composite_sql(RUN_DAYS)),
    ("stored", bucket_sql(P.HOUR).replace("from composite", "from c_old")),
    ("run", bucket_sql(P.HOUR).replace("from composite", "from c_new"))]))
def q_upsert_hours(fx):
    stored = bucket_sums(_comp(fx, STORED_DAYS), P.HOUR)
    run = bucket_sums(_comp(fx, RUN_DAYS), P.HOUR)
    return upsert_rows(stored, run, ["timestamp", "subreddit"])


@register("q_upsert_days", with_fixtures(UPSERT_SQL, VIEWS3, [
    ("c_old", _composite_sql(STORED_DAYS)), ("c_new", _composite_sql(RUN_DAYS)),
    ("s_old", bucket_sql(P.DAY).replace("from composite", "from c_old")),
    ("s_new", bucket_sql(P.DAY).replace("from composite", "from c_new")),
    ("stored", sma_sql("s_old")), ("run", sma_sql("s_new"))]))
def q_upsert_days(fx):
    stored = moving_average(bucket_sums(_comp(fx, STORED_DAYS), P.DAY))
    run = moving_average(bucket_sums(_comp(fx, RUN_DAYS), P.DAY))
    return upsert_rows(stored, run, ["timestamp", "subreddit"])


# ---- post-table upserts (SNK-3, SNK-4, SNK-5) and ingest (Q-7) -----------------

POST_BATCH_FIELDS = ["subreddit", "created", "selftext_length", "title_length"]
_DIFF_POSTS = " or ".join(f"s.{c} is distinct from b.{c}" for c in POST_BATCH_FIELDS)


@register("q_upsert_posts", with_fixtures(f"""
select * from submissions s where not exists (select 1 from poll_batch b where b.id = s.id)
union all
select b.id, b.subreddit, b.title_length, s.hide_score, b.created, s.author_fullname,
  b.selftext_length, s.post_hint, s.url
from poll_batch b left join submissions s on s.id = b.id""", ["submissions", "poll_batch"]))
def q_upsert_posts(fx):
    return ingest(fx.poll_batch(), fx.submissions(), fx.scores(), fx.stored_sentiments(),
                  fx.lexicon(), AS_OF).posts


@register("q_post_actions", with_fixtures(f"""
select b.id, b.polled_at, case when s.id is null then 'new' when {_DIFF_POSTS} then 'changed'
  else 'same' end action
from poll_batch b left join submissions s on s.id = b.id""", ["submissions", "poll_batch"]))
def q_post_actions(fx):
    return ingest(fx.poll_batch(), fx.submissions(), fx.scores(), fx.stored_sentiments(),
                  fx.lexicon(), AS_OF).post_actions


_METRICS = ["upvote_ratio", "ups", "score", "num_comments"]
_DIFF_SCORES = " or ".join(f"o.{c} is distinct from n.{c}" for c in _METRICS)
_SAME_SCORES = " and ".join(f"{c} is not distinct from lag({c}) over w" for c in _METRICS)
# every stored and polled row of the polled ids, in order; chg: differs from the row before it
SCORE_RUNS_SQL = f"""
select *, row_number() over w = 1 or not ({_SAME_SCORES}) chg
from (select 0 src, * from scores_old where id in (select id from scores_new)
      union all select 1 src, * from scores_new) u
window w as (partition by id order by src, "timestamp")"""


@register("q_upsert_scores", with_fixtures(f"""
select * from scores_old o where not exists (select 1 from scores_new n where n.id = o.id)
union all
select id, "timestamp", {", ".join(_METRICS)} from (
  select *, row_number() over (partition by id order by src desc, "timestamp" desc) back from runs where chg) r
where back = 1""", ["scores_old", "scores_new"], [("runs", SCORE_RUNS_SQL)]))
def q_upsert_scores(fx):
    return upsert_scores(fx.scores_old(), fx.scores_new())[0]


@register("q_score_changes", with_fixtures("""
select id, "timestamp", chg changed from runs where src = 1""", ["scores_old", "scores_new"],
                                           [("runs", SCORE_RUNS_SQL)]))
def q_score_changes(fx):
    return upsert_scores(fx.scores_old(), fx.scores_new())[1]


GATED = (f"selftext is not null and title_length >= {P.GATE_MIN_TITLE} "
         f"and selftext_length >= {P.GATE_MIN_BODY}")
INCR_CTES = [
    ("hashed", f"select id, title, selftext, sha256('{P.SCORER_VERSION}' || title || selftext) hash_check "
               f"from poll_batch where {GATED}"),
    ("todo", "select * from hashed h where not exists (select 1 from stored_sentiments s "
             "where s.id = h.id and s.hash_check = h.hash_check)"),
    ("todo_text", "select id, title || chr(10) || selftext txt from todo"),
] + text_ctes(T.FULL, source="todo_text") + [
    ("fresh", f"select d.id, t.hash_check, cast({AS_OF} as bigint) updated_timestamp, "
              "d.sentiment sentiment_value from doc_scores d join todo t on t.id = d.id"),
]


@register("q_sentiment_incremental", with_fixtures("""
select * from stored_sentiments s where not exists (select 1 from fresh f where f.id = s.id)
union all select * from fresh""", ["poll_batch", "stored_sentiments", "lexicon"], INCR_CTES))
def q_sentiment_incremental(fx):
    return incremental_sentiment(fx.stored_sentiments(), fx.poll_batch(), fx.lexicon(), AS_OF)[0]


@register("q_ingest_counts", with_fixtures(f"""
select 'total' counter, cast(count(*) as bigint) n from poll_batch
union all select 'new_posts', cast(count(*) as bigint) from poll_batch b
  where not exists (select 1 from submissions s where s.id = b.id)
union all select 'score_updates', cast(count(*) as bigint) from poll_batch b
  left join submission_scores o on o.id = b.id
  where o.id is null or {_DIFF_SCORES.replace('n.', 'b.')}
union all select 'sentiment_updates', cast(count(*) as bigint) from todo""",
    ["submissions", "submission_scores", "poll_batch", "stored_sentiments"], INCR_CTES[:2]))
def q_ingest_counts(fx):
    return ingest(fx.poll_batch(), fx.submissions(), fx.scores(), fx.stored_sentiments(),
                  fx.lexicon(), AS_OF).counts()




@register("q_dedupe_polls", with_fixtures("""
select distinct * from (select * from poll_batch union all select * from poll_batch) u""", ["poll_batch"]))
def q_dedupe_polls(fx):
    """Redelivered poll rows dropped on (id, polled_at), here over a batch
    that holds every poll twice."""
    from moodcast.streaming.jobs import dedupe_polls
    b = fx.poll_batch()
    return dedupe_polls(b.unionByName(b))
