"""DuckDB SQL of the operators that SQL expresses, for the queries of the same names."""

from __future__ import annotations

import re

from moodcast.llm import chat_format, license_scan

# a control string: backslashes may stand between its first character and the rest
_ESCAPES = [(chat_format._quote(c), rest) for c, rest in chat_format.DEFAULT.patterns()]


def _escaped(text: str) -> str:
    for c, rest in _ESCAPES:
        text = rf"regexp_replace({text}, '{c}(\\*{rest})', '{c.lstrip(chr(92))}\\\1', 'g')"
    return text


_MARKS = " ".join(f"when '{t.role}' then {len(t.open) + len(t.close) + 2}" for t in chat_format.DEFAULT.turns)

CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_escaped("text")}) + case role {_MARKS} end) as bigint) as formatted_chars,
  regexp_full_match(string_agg(role, ',' order by turn, role, text), '(system,)?(user,assistant,)*user(,assistant)?|system') as valid
from turns group by conv_id
"""


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    start = r"^[^A-Za-z0-9]*(?:portions )?copyright"
    marked = start + r"\b[^A-Za-z]*(?:\(c\)|©|[0-9])|^[^A-Za-z0-9]*(?:\(c\) |© ?[0-9]|all rights reserved)"
    named = rf"{start} .*\b(?:{'|'.join(license_scan.HOLDER_WORDS)})\b"
    terms = rf"{start} (?:{'|'.join(license_scan.TERMS_AFTER)})\b"
    out = (f"array_to_string(list_transform(string_split(lower({text}), chr(10)), lambda l: case when regexp_matches(l, {_sql(marked)}) "
           f"or (regexp_matches(l, {_sql(named)}) and not regexp_matches(l, {_sql(terms)})) then ' ' else l end), chr(10))")
    word = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", license_scan.NOT_A_WORD)   # the spelling of RE2
    out = f"trim(regexp_replace({out}, {_sql(word)}, ' ', 'g'))"
    for old, new in license_scan.SPELLINGS:
        out = f"regexp_replace({out}, {_sql(rf'{chr(92)}b{old}{chr(92)}b')}, {_sql(new)}, 'g')"
    return out


_KNOWN = ", ".join(f"({_sql(name)}, {_sql(text)})" for name, text in license_scan.KNOWN)

LICENSES = f"""
with known as (select distinct md5({_canonical("t")}) as digest, l as license from (values {_KNOWN}) k(l, t)),
units as (
  select doc_id, 'text' as unit, 0 as position, text as part from documents
  union all
  select doc_id, 'paragraph', p - 1, parts[p] from (
    select doc_id, parts, unnest(range(1, len(parts) + 1)) as p from (
      select doc_id, string_split_regex(text, '\\n[ \\t]*\\n\\s*') as parts from documents) where len(parts) > 1)
  where contains(parts[p], chr(10))
  union all
  select doc_id, 'line', p - 1, parts[p] from (
    select doc_id, parts, unnest(range(1, len(parts) + 1)) as p from (
      select doc_id, string_split(text, chr(10)) as parts from documents) where len(parts) > 1))
select doc_id, unit, cast(position as integer) as position, license, digest
from (select doc_id, unit, position, md5(c) as digest from (
  select doc_id, unit, position, {_canonical("part")} as c from units) where c <> '')
join known using (digest)
"""

_YEAR = 365 * 86_400
_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', '')"


def _number(text: str, first: int = 1) -> str:
    return f"cast('0x' || substr(md5({text}), {first}, 8) as bigint)"


URL_LISTS = f"""
with pages2 as (select page_id, url, 1704067200 + {_number("cast(page_id as varchar)")} % {_YEAR} as fetched_at, {_HOST} as host from pages),
keys as (
  select distinct key from (
    select host as key from pages2
    union all select regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) from pages2
    union all select host || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) from pages2)
  where key <> '' and key not like '%/'),
days as (
  select key, {_number("key")} % 10 as pick, 1704067200 + {_number("key", 9)} % {_YEAR} as t0,
    86400 + {_number("key", 17)} % (90 * 86400) as d1, 86400 + {_number("key", 25)} % (60 * 86400) as d2 from keys),
changes as (
  select key, pick, 'add' as action, t0 as time from days where pick < 5
  union all select key, pick, 'remove', t0 + d1 from days where pick < 3
  union all select key, pick, 'add', t0 + d1 + d2 from days where pick < 1),
intervals as (
  select case when pick % 2 = 0 then 'spam' else 'partners' end as list, case when pick % 2 = 0 then 'block' else 'allow' end as verdict,
    key, action, time as valid_from, coalesce(lead(time) over (partition by key order by time), 1152921504606846976) as valid_to from changes),
parts as (
  select *, string_split(host, '.') as labels,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as segments from pages2),
asked as (
  select page_id, url, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))))) as key
  from parts where host <> ''),
hits as (
  select page_id, url, fetched_at, list, verdict, key from asked join intervals using (key)
  where action = 'add' and fetched_at >= valid_from and fetched_at < valid_to),
best as (
  select page_id, url, fetched_at, array_to_string(list_sort(list_distinct(list(list))), ',') as lists,
    max(struct_pack(n := length(key), b := verdict = 'block', key := key, verdict := verdict)) as best
  from hits group by page_id, url, fetched_at)
select p.page_id, p.url, p.fetched_at, best.verdict as verdict, best.key as matched_key, coalesce(lists, '') as lists
from pages2 p left join best b on p.page_id = b.page_id and p.url = b.url and p.fetched_at = b.fetched_at
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

ORACLE = {"op2_license_digests": LICENSES, "op8_chat_format": CHAT, "op10_temporal_url_lists": URL_LISTS,
          "op12_va_top_k": TOP_K}
