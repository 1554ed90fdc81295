"""The FIXTURES.md part B views in DuckDB's dialect, as CTE bodies.

``with_fixtures(sql, names)`` prefixes a query with the views it names, so
each oracle query reads only the driver's tables (events, documents).
"""

from __future__ import annotations

EPOCH = "cast(floor(epoch(ts)) as bigint)"

VIEWS = {
    "submissions": f"""
select cast(event_id as varchar) id, event_type subreddit,
  cast(length(props) + event_id % 5 as int) title_length,
  event_id % 7 = 0 hide_score,
  {EPOCH} created,
  case when event_id % 11 = 0 then null else 't2_' || user_id end author_fullname,
  cast(floor(value * 5) as int) selftext_length,
  case when event_id % 2 = 0 then 'self' end post_hint,
  '/r/' || event_type || '/comments/' || event_id || '/post_' || user_id || '/' url
from events""",
    "submission_scores": f"""
select cast(event_id as varchar) id, {EPOCH} + 600 "timestamp",
  cast(event_id % 101 as double) / 100 upvote_ratio,
  cast(case when user_id > 20 then user_id - 20 else 0 end as int) ups,
  cast(user_id - 20 as int) score,
  cast(event_id * 13 % 57 as int) num_comments
from events where event_id % 10 <> 0""",
    "submission_sentiments": f"""
select cast(event_id as varchar) id, {EPOCH} + 900 updated_timestamp,
  cast((event_id * 37) % 201 - 100 as double) / 100 sentiment_value
from events where event_id % 4 <> 0""",
    "finance_indexes": f"""
select "timestamp", name, max(value) "value" from (
  select cast(floor({EPOCH} / 86400.0) * 86400 as bigint) "timestamp",
    case when event_type in ('click', 'view') then 'nasdaq' else 'bitcoin' end name, value
  from events) e
group by "timestamp", name""",
    "price_pages": """
select 'n' || "timestamp" page_id, 'nasdaq' name,
  '<table><tr class="datatable_row__Hk3IV"><td>Date</td><td>Price</td></tr>'
  || '<tr class="datatable_row__Hk3IV"><td><time>' || substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/'
  || substr(d, 1, 4) || '</time></td><td> 1,' || lpad(cast(cast(floor(value) as int) as varchar), 3, '0')
  || '.50 </td></tr></table>' html
from (select f.*, cast(cast(timestamp '1970-01-01 00:00:00' + interval '1' second * "timestamp" as date) as varchar) d
      from finance_indexes f where name = 'nasdaq') x
union all
select 'b' || "timestamp", 'bitcoin',
  '<div id="results_box"><table><tbody><tr><td data-real-value="' || "timestamp" || '">x</td>'
  || '<td data-real-value="1,' || lpad(cast(cast(floor(value) as int) as varchar), 3, '0') || '.25">y</td></tr>'
  || '<tr><td>no attribute</td><td>z</td></tr></tbody></table></div>'
from finance_indexes where name = 'bitcoin'""",
    "scores_old": """
select * from submission_scores where cast(id as bigint) % 10 < 6""",
    "scores_new": """
select id, "timestamp" + 1200 * (k + 1) "timestamp", upvote_ratio, ups,
  cast(score + case when k = 1 or (k = 2 and cast(id as bigint) % 2 = 0) then
      case when cast(id as bigint) % 5 = 0 then 9 when cast(id as bigint) % 3 = 0 then 5 else 0 end
    when cast(id as bigint) % 3 = 0 then 5 else 0 end as int) score, num_comments
from (select *, unnest(range(0, 2 + cast(id as bigint) % 3)) k from submission_scores where cast(id as bigint) % 10 >= 4) p""",
    "polled_posts": """
select * replace (['wallstreetbets', 'bitcoin', 'stocks', 'StockMarket', 'investing', 'cryptocurrency', 'ethereum',
  'altcoin', 'Bitcoin', 'options'][cast(id as bigint) % 10 + 1] as subreddit) from submissions""",
    "raw_posts": """
select cast(doc_id as varchar) id, source subreddit, substr(text, 1, 40) title, text selftext,
  1704067200 + doc_id * 600 created,
  cast(length(text) as int) selftext_length, cast(length(substr(text, 1, 40)) as int) title_length
from documents""",
    "poll_batch": """
select *, created + 1200 polled_at, cast(cast(id as bigint) * 7 % 100 as double) / 100 upvote_ratio,
  cast(cast(id as bigint) % 50 as int) ups, cast(cast(id as bigint) % 50 - 5 as int) score,
  cast(cast(id as bigint) % 13 as int) num_comments
from raw_posts""",
    "stored_sentiments": """
select id, sha256(case when created < 1704240000 then 'SentimentAnalyzer_v1' else 'SentimentAnalyzer_v0' end
    || title || selftext) hash_check,
  cast(1706572800 as bigint) updated_timestamp, cast(0.0 as double) sentiment_value
from raw_posts
where selftext is not null and title_length >= 10 and selftext_length >= 100""",
    "rule_posts": """
select * replace (case cast(id as bigint) % 10
    when 0 then replace(selftext, ' the ', ' not the ')
    when 1 then replace(selftext, ' the ', ' very the ')
    when 2 then replace(selftext, ' the ', ' VERY the ')
    when 3 then replace(selftext, ' the ', ' never so the ')
    when 4 then replace(selftext, ' and ', ' but ')
    when 5 then replace(selftext, ' the ', ' least the ')
    when 6 then replace(selftext, ' the ', ' sort of the ')
    when 7 then replace(selftext, ' the ', ' the bomb ')
    when 8 then replace(selftext, ' the ', ' THE ')
    when 9 then replace(selftext, ' the ', ' for very the ') end as selftext)
from raw_posts""",
    "lexicon": """
select 'the' word, cast(1.5 as double) valence
union all select 'and', cast(-0.8 as double)
union all select 'that', cast(-1.9 as double)
union all select 'for', cast(0.6 as double)""",
}

# Views a view reads (so they are emitted first).
DEPENDS = {
    "price_pages": ["finance_indexes"],
    "polled_posts": ["submissions"],
    "scores_old": ["submission_scores"],
    "scores_new": ["submission_scores"],
    "poll_batch": ["raw_posts"],
    "rule_posts": ["raw_posts"],
    "stored_sentiments": ["raw_posts"],
}


def with_fixtures(sql: str, names: list[str], extra: list[tuple[str, str]] = ()) -> str:
    """``WITH <views...>, <extra ctes...> <sql>``."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in order]
    ctes += [f"{n} AS ({body.strip()})" for n, body in extra]
    if not ctes:
        return sql.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + sql.strip()
