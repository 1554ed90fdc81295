"""Registered queries for post text: lengths, gate, hash, sentences, polarity."""

from __future__ import annotations

from moodcast import params as P
from moodcast.functions.exprs import content_hash, sentiment_label, text_length
from moodcast.operators import text as T
from moodcast.operators.ingest import scoring_gate
from moodcast.plans.oracle_fixtures import with_fixtures
from moodcast.plans.registry import register


def _posts_text(fx):
    return fx.raw_posts().withColumn("text", T.post_text("title", "selftext"))


def _tasks(fx) -> int:
    """The given documents lie in one row group, so they are dealt over the cores."""
    return fx.spark.sparkContext.defaultParallelism


# ---- DuckDB text pipeline (oracle) -------------------------------------------
# Written from the method's description, with its own numbers and patterns; only
# the word lists (fixed values) are shared with the operator.

def _inlist(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _d(x: str) -> str:
    return f"cast({x} as double)"


def _count(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, '{ch}', '')))"


def _upper(t: str) -> str:
    return f"(regexp_matches({t}, '\\p{{Lu}}') and not regexp_matches({t}, '\\p{{Ll}}'))"


def _rule_steps(rules: T.Rules) -> list[str]:
    """Successive values of ``v``."""
    steps = []
    if rules.caps:
        steps.append(f"case when up0 and capdiff then case when v > 0 then v + {_d('0.733')} "
                     f"else v - {_d('0.733')} end else v end")
    for k, scale in ((1, "1.0"), (2, "0.95"), (3, "0.9")):
        free = f"p{k} is not null and lower(p{k}) not in (select word from lexicon)"
        if rules.degree:
            b = (f"(case when lower(p{k}) in {_inlist(T.BOOSTERS_UP)} then {_d('0.293')} "
                 f"else {_d('-0.293')} end * case when v < 0 then -1 else 1 end)")
            if rules.caps:
                b = (f"({b} + case when up{k} and capdiff then case when v > 0 then {_d('0.733')} "
                     f"else {_d('-0.733')} end else {_d('0')} end)")
            steps.append(f"case when {free} and lower(p{k}) in {_inlist(T.BOOSTERS_UP + T.BOOSTERS_DOWN)} "
                         f"then v + {b} * {_d(scale)} else v end")
        if rules.negation:
            special = {1: "", 2: f"when p2 = 'never' and p1 in ('so', 'this') then v * {_d('1.5')} ",
                       3: f"when (p3 = 'never' and p2 in ('so', 'this')) or p1 in ('so', 'this') "
                          f"then v * {_d('1.25')} "}[k]
            steps.append(f"case when not ({free}) then v {special}when lower(p{k}) in {_inlist(T.NEGATIONS)} "
                         f"or contains(lower(p{k}), 'n''t') then v * {_d('-0.74')} else v end")
        if k == 3 and rules.idioms:
            phrases = ["p1 || ' ' || tok", "p2 || ' ' || p1 || ' ' || tok", "p2 || ' ' || p1",
                       "p3 || ' ' || p2 || ' ' || p1", "p3 || ' ' || p2"]
            for group in (phrases, ["tok || ' ' || n1"], ["tok || ' ' || n1 || ' ' || n2"]):
                whens = " ".join(f"when {ph} = '{t}' then {_d(repr(x))}" for ph in group for t, x in T.IDIOMS)
                steps.append(f"case when not ({free}) then v {whens} else v end")
        if k == 3 and rules.degree:
            pairs = _inlist(T.BOOSTER_PAIRS)
            steps.append(f"case when {free} and (p3 || ' ' || p2 in {pairs} or p2 || ' ' || p1 in {pairs}) "
                         f"then v - {_d('0.293')} else v end")
    if rules.negation:
        steps.append("case when lower(p1) = 'least' and 'least' not in (select word from lexicon) "
                     f"and coalesce(lower(p2), '') not in ('at', 'very') then v * {_d('-0.74')} else v end")
    if rules.degree:
        steps.append(f"case when lower(tok) in {_inlist(T.BOOSTERS_UP + T.BOOSTERS_DOWN)} "
                     f"or (lower(tok) = 'kind' and lower(n1) = 'of') then {_d('0')} else v end")
    if rules.but:
        steps.append(f"case when but_at = 0 then v when tpos < but_at then v * {_d('0.5')} "
                     f"when tpos > but_at then v * {_d('1.5')} else v end")
    return steps


def text_ctes(rules: T.Rules, source: str = "posts_text") -> list[tuple[str, str]]:
    """CTEs: docs(id, n_sent), sent_scores(id, sent_idx, polarity) for all sentences."""
    q = _count("sentence", "?")
    amp = (f"least({_count('sentence', '!')}, 4) * {_d('0.292')} + case when {q} > 3 then {_d('0.96')} "
           f"when {q} > 1 then {q} * {_d('0.18')} else {_d('0')} end")
    marks = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
    ends = r"regexp_replace(regexp_replace(txt, '[\t\r\f ]+', ' ', 'g'), '([.!?]+[\])''\"]*) ', '\1' || chr(10), 'g')"
    ctes = [
        ("docs0", f"select id, coalesce(list_filter(list_transform(string_split({ends}, chr(10)), lambda s: trim(s, ' ')), "
                  f"lambda s: regexp_matches(s, '[^.!? ]')), []) ss from {source}"),
        ("docs", "select id, cast(len(ss) as int) n_sent from docs0"),
        ("sents", "select id, cast(i - 1 as int) sent_idx, ss[i] sentence from "
                  "(select id, ss, unnest(generate_series(1, len(ss))) i from docs0) x"),
        ("words", f"select *, list_transform(list_filter(string_split(sentence, ' '), lambda t: length(t) > 1), "
                  f"lambda t: case when length(trim(t, {marks})) > 1 then trim(t, {marks}) else t end) toks from sents"),
        ("sfeat", f"select id, sent_idx, toks, {amp} amp, "
                  "coalesce(list_position(list_transform(toks, lambda t: lower(t)), 'but'), 0) but_at, "
                  f"len(list_filter(toks, lambda t: {_upper('t')})) ncaps from words"),
        ("tokens", "select id, sent_idx, amp, but_at, ncaps between 1 and len(toks) - 1 capdiff, toks[j] tok, j tpos, "
                   "case when j > 1 then toks[j - 1] end p1, case when j > 2 then toks[j - 2] end p2, "
                   "case when j > 3 then toks[j - 3] end p3, case when j < len(toks) then toks[j + 1] end n1, "
                   "case when j < len(toks) - 1 then toks[j + 2] end n2 "
                   "from (select *, unnest(generate_series(1, len(toks))) j from sfeat) z"),
        ("hits0", f"select t.*, l.valence v, {_upper('tok')} up0, "
                  + ", ".join(f"coalesce({_upper(f'p{k}')}, false) up{k}" for k in (1, 2, 3))
                  + " from tokens t join lexicon l on lower(t.tok) = l.word"),
    ]
    chain = "hits0"
    for i, expr in enumerate(_rule_steps(rules), start=1):
        ctes.append((f"hits{i}", f"select * replace ({expr} as v) from {chain}"))
        chain = f"hits{i}"
    x2 = "case when x > 0 then x + amp when x < 0 then x - amp else x end" if rules.punctuation else "x"
    ctes += [
        ("sagg", f"select id, sent_idx, cast(sum(cast(v as {P.VALENCE_DECIMAL})) as double) x, "
                 f"max(amp) amp from {chain} group by id, sent_idx"),
        ("sagg2", f"select id, sent_idx, {x2} x2 from sagg"),
        ("sent_scores", "select s.id, s.sent_idx, "
                        f"coalesce(cast(round(cast(a.x2 / sqrt(a.x2 * a.x2 + {_d('15')}) as decimal(38,9)), 4) "
                        "as double), 0.0) polarity "
                        "from sents s left join sagg2 a on s.id = a.id and s.sent_idx = a.sent_idx"),
        ("doc_scores", "select d.id, d.n_sent n_sentences, case when d.n_sent > 0 then "
                       f"cast(coalesce(sum(cast(s.polarity as {P.POLARITY_DECIMAL})), 0) as double) "
                       "/ d.n_sent end sentiment "
                       "from docs d left join sent_scores s on d.id = s.id group by d.id, d.n_sent"),
    ]
    return ctes


POSTS_TEXT = ("posts_text", "select id, title || chr(10) || selftext txt from raw_posts")


RULES_TEXT = ("posts_text", "select id, title || chr(10) || selftext txt from rule_posts")


def text_sql(body: str, rules: T.Rules, posts: tuple[str, str] = POSTS_TEXT) -> str:
    names = ["raw_posts" if posts is POSTS_TEXT else "rule_posts", "lexicon"]
    return with_fixtures(body, names, [posts] + text_ctes(rules))


# ---- registered queries ------------------------------------------------------

@register("q_text_lengths", with_fixtures("""
select id, cast(coalesce(length(title), 0) as int) title_length,
  cast(coalesce(length(selftext), 0) as int) selftext_length from raw_posts""", ["raw_posts"]))
def q_text_lengths(fx):
    p = fx.raw_posts()
    return p.select("id", text_length("title").alias("title_length"),
                    text_length("selftext").alias("selftext_length"))


GATE_WHERE = (f"selftext is not null and title_length >= {P.GATE_MIN_TITLE} "
              f"and selftext_length >= {P.GATE_MIN_BODY}")


@register("q_scoring_gate", with_fixtures(f"""
select id, subreddit, title_length, selftext_length from raw_posts where {GATE_WHERE}""", ["raw_posts"]))
def q_scoring_gate(fx):
    return scoring_gate(fx.raw_posts()).select("id", "subreddit", "title_length", "selftext_length")


@register("q_content_hash", with_fixtures(f"""
select id, sha256('{P.SCORER_VERSION}' || title || selftext) hash_check
from raw_posts where {GATE_WHERE}""", ["raw_posts"]))
def q_content_hash(fx):
    return scoring_gate(fx.raw_posts()).select(
        "id", content_hash("title", "selftext").alias("hash_check"))


@register("q_sentences", text_sql(
    "select id, sent_idx, sentence from sents", T.BASE))
def q_sentences(fx):
    return T.sentences(_posts_text(fx), "id", "text", spread=_tasks(fx))


@register("q_sentence_polarity", text_sql("select * from sent_scores", T.BASE))
def q_sentence_polarity(fx):
    return T.sentence_polarity(_posts_text(fx), "id", "text", fx.lexicon(), T.BASE, spread=_tasks(fx))


@register("q_text_sentiment", text_sql("select * from doc_scores", T.BASE))
def q_text_sentiment(fx):
    return T.text_sentiment(_posts_text(fx), "id", "text", fx.lexicon(), T.BASE, spread=_tasks(fx))


@register("q_polarity_rules", text_sql("select * from doc_scores", T.FULL, RULES_TEXT))
def q_polarity_rules(fx):
    posts = fx.rule_posts().withColumn("text", T.post_text("title", "selftext"))
    return T.text_sentiment(posts, "id", "text", fx.lexicon(), T.FULL, spread=_tasks(fx))


@register("q_sentiment_label", text_sql(f"""
select id, sentiment, case when sentiment >= {P.LABEL_CUT} then 'Positive'
  when sentiment <= -{P.LABEL_CUT} then 'Negative' when sentiment is not null then 'Neutral' end label
from doc_scores""", T.FULL))
def q_sentiment_label(fx):
    s = T.text_sentiment(_posts_text(fx), "id", "text", fx.lexicon(), T.FULL, spread=_tasks(fx))
    return s.select("id", "sentiment", sentiment_label("sentiment").alias("label"))


