"""The stored tables, derived from the driver's test data (FIXTURES.md part B).

Each function is a plain DataFrame transformation of a given table, so the
derived tables grow with the input: ``submissions`` has one row per event,
``raw_posts`` one per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodcast.sources.tables import load

# Fixed clock of every test run (2024-01-31T00:00:00Z) and its retention.
AS_OF = 1706659200
RETENTION_DAYS = 20


def epoch(c: str) -> Column:
    """Whole epoch seconds of an event time (timestamp_ntz is read as UTC)."""
    return F.unix_timestamp(F.col(c)).cast("bigint")


def _eid() -> Column:
    return F.col("event_id")


def submissions(events: DataFrame) -> DataFrame:
    return events.select(
        _eid().cast("string").alias("id"),
        F.col("event_type").alias("subreddit"),
        (F.char_length("props") + _eid() % 5).cast("int").alias("title_length"),
        (_eid() % 7 == 0).alias("hide_score"),
        epoch("ts").alias("created"),
        F.when(_eid() % 11 != 0, F.concat(F.lit("t2_"), F.col("user_id").cast("string")))
         .alias("author_fullname"),
        F.floor(F.col("value") * 5).cast("int").alias("selftext_length"),
        F.when(_eid() % 2 == 0, F.lit("self")).alias("post_hint"),
        F.concat(F.lit("/r/"), F.col("event_type"), F.lit("/comments/"), _eid().cast("string"),
                 F.lit("/post_"), F.col("user_id").cast("string"), F.lit("/")).alias("url"),
    )


def submission_scores(events: DataFrame) -> DataFrame:
    uid = F.col("user_id")
    return events.filter(_eid() % 10 != 0).select(
        _eid().cast("string").alias("id"),
        (epoch("ts") + 600).alias("timestamp"),
        ((_eid() % 101).cast("double") / 100).alias("upvote_ratio"),
        F.when(uid > 20, uid - 20).otherwise(F.lit(0)).cast("int").alias("ups"),
        (uid - 20).cast("int").alias("score"),
        (_eid() * 13 % 57).cast("int").alias("num_comments"),
    )


def submission_sentiments(events: DataFrame) -> DataFrame:
    return events.filter(_eid() % 4 != 0).select(
        _eid().cast("string").alias("id"),
        (epoch("ts") + 900).alias("updated_timestamp"),
        ((_eid() * 37 % 201 - 100).cast("double") / 100).alias("sentiment_value"),
    )


def finance_indexes(events: DataFrame) -> DataFrame:
    day = (F.floor(epoch("ts") / 86400.0) * 86400).cast("bigint")
    name = F.when(F.col("event_type").isin("click", "view"), F.lit("nasdaq")).otherwise(F.lit("bitcoin"))
    return (events.select(day.alias("timestamp"), name.alias("name"), "value")
            .groupBy("timestamp", "name").agg(F.max("value").alias("value")))


def price_pages(events: DataFrame) -> DataFrame:
    f = finance_indexes(events)
    price3 = F.lpad(F.floor("value").cast("int").cast("string"), 3, "0")
    d = F.date_from_unix_date((F.col("timestamp") / 86400).cast("int")).cast("string")
    nasdaq = f.filter(F.col("name") == "nasdaq").select(
        F.concat(F.lit("n"), F.col("timestamp").cast("string")).alias("page_id"),
        F.lit("nasdaq").alias("name"),
        F.concat(
            F.lit('<table><tr class="datatable_row__Hk3IV"><td>Date</td><td>Price</td></tr>'),
            F.lit('<tr class="datatable_row__Hk3IV"><td><time>'), F.substring(d, 6, 2), F.lit("/"),
            F.substring(d, 9, 2), F.lit("/"), F.substring(d, 1, 4), F.lit("</time></td><td> 1,"),
            price3, F.lit(".50 </td></tr></table>")).alias("html"))
    bitcoin = f.filter(F.col("name") == "bitcoin").select(
        F.concat(F.lit("b"), F.col("timestamp").cast("string")).alias("page_id"),
        F.lit("bitcoin").alias("name"),
        F.concat(
            F.lit('<div id="results_box"><table><tbody><tr><td data-real-value="'),
            F.col("timestamp").cast("string"), F.lit('">x</td>'),
            F.lit('<td data-real-value="1,'), price3, F.lit('.25">y</td></tr>'),
            F.lit("<tr><td>no attribute</td><td>z</td></tr></tbody></table></div>")).alias("html"))
    return nasdaq.unionByName(bitcoin)


# The row of FIXTURES.md for each remainder of the event id by ten, in this
# order, for both layouts: {d} the date or time, {v} the price with a thousands comma,
# {p} its three digits after that comma.
ROWS_A = (
    '<tr class="datatable_row__Hk3IV"><td><time>{d}</time></td><td> {v} </td></tr>',
    "<tr data-n='1 > 0' class='odd datatable_row__Hk3IV'><td><time>{d}</time></td><td>{v}</td></tr>",
    '<tr class="datatable_row__Hk3IVx"><td><time>1/1/2000</time></td><td>9</td></tr>'
    '<tr class=datatable_row__Hk3IV><td><time>{d}</time></td><td>{v}</td></tr>',
    '<TR CLASS="datatable_row__Hk3IV"><TD><TIME>{d}</TIME></TD><TD>{v}</TD></TR>',
    '<!-- <tr class="datatable_row__Hk3IV"><td><time>1/1/2000</time></td><td>9</td></tr> -->'
    '<tr class="datatable_row__Hk3IV"><td><time>{d}</time></td><td>{v}</td></tr>',
    '<tr class="datatable_row__Hk3IV"><td>{d}</td><td>{v}</td></tr>',
    '<tr class="datatable_row__Hk3IV"><td><time>{d}</time><td>{v}',
    '<tr class="datatable_row__Hk3IV"><td><time>{d}</time></td><td>{v}</td>'
    '<td><table><tr><td>x</td><td>5</td></tr></table></td></tr>',
    '<tr class="datatable_row__Hk3IV"><td>&nbsp;<time>{d}</time></td><td><b>1&#44;</b>{p}&#x2e;50&nbsp;</td></tr>',
    '<tr class="datatable_row__Hk3IV"><td><time>{d}</time></td><td>n/a</td></tr>',
)
ROWS_B = (
    '<tr><td data-real-value="{d}">x</td><td data-real-value="{v}">y</td></tr>',
    "<tr><td class='a > b' data-real-value='{d}'>x</td><td data-real-value='{v}'>y</td></tr>",
    '<tr><td data-real-value={d}>x</td><td data-real-value={v}>y</td></tr>',
    '<TR><TD DATA-REAL-VALUE="{d}">x</TD><TD DATA-REAL-VALUE="{v}">y</TD></TR>',
    '<!-- <tr><td data-real-value="1">x</td><td data-real-value="2">y</td></tr> -->'
    '<tr><td data-real-value="{d}">x</td><td data-real-value="{v}">y</td></tr>',
    '<tr><td>no attribute</td><td data-real-value="{v}">y</td></tr>',
    '<tr><td data-real-value="{d}">x<td data-real-value="{v}">y',
    '<tr><td data-real-value="{d}">x</td><td data-real-value="{v}"><div>y</div></td>'
    '<td><table><tr><td data-real-value="1">x</td><td data-real-value="2">y</td></tr></table></td></tr>',
    '<tr><td data-real-value="{d}">x</td><td title=" data-real-value=7" data-real-value="1&#44;{p}&#x2E;25">y</td></tr>',
    '<tr><td data-real-value="{d}">x</td><td data-real-value="">y</td></tr>',
)
PAGE_A = ("<html><script>var t = '<tr class=\"datatable_row__Hk3IV\"><td><time>1/2/2001</time></td><td>7</td></tr>';</script>"
          "<body><table>", "</table></body></html>")
PAGE_B = ('<div><div id=results_box><div><table><thead><tr><td data-real-value="1">a</td><td data-real-value="2">b</td></tr>'
          '</thead><tbody>', '</tbody></table></div></div><table><tbody><tr><td data-real-value="1">a</td>'
          '<td data-real-value="2">b</td></tr></tbody></table></div>')
PAGE_EVENTS = 100


def price_archive(events: DataFrame) -> DataFrame:
    """Pages of many rows, malformed and nested ones included: one for each 100 event ids and series."""
    digits = F.lpad((F.floor("value").cast("bigint") % 1000).cast("string"), 3, "0")
    day = F.date_format(F.date_from_unix_date(F.floor(epoch("ts") / 86400.0).cast("int")), "MM/dd/yyyy")

    def rows(forms, when: Column, cents: str) -> Column:
        price = F.concat(F.lit("1,"), digits, F.lit(cents))
        form = F.get(F.array(*[F.lit(x) for x in forms]), F.pmod(_eid(), F.lit(10)).cast("int"))
        return F.replace(F.replace(F.replace(form, F.lit("{d}"), when), F.lit("{v}"), price), F.lit("{p}"), digits)

    first = F.col("event_type").isin("click", "view")
    row = F.when(first, rows(ROWS_A, day, ".50")).otherwise(rows(ROWS_B, epoch("ts").cast("string"), ".25"))
    name = F.when(first, F.lit("nasdaq")).otherwise(F.lit("bitcoin"))
    page = F.floor(_eid() / F.lit(PAGE_EVENTS)).cast("string")
    pages = (events.select(F.concat(F.substring(name, 1, 1), page).alias("page_id"), name.alias("name"), _eid().alias("e"),
                           row.alias("row")).groupBy("page_id", "name")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "row"))), lambda x: x["row"]), "")
                  .alias("rows")))
    a = F.col("name") == "nasdaq"
    return pages.select("page_id", "name", F.concat(
        F.when(a, F.lit(PAGE_A[0])).otherwise(F.lit(PAGE_B[0])), "rows",
        F.when(a, F.lit(PAGE_A[1])).otherwise(F.lit(PAGE_B[1]))).alias("html"))


def scores_old(events: DataFrame) -> DataFrame:
    """The stored side: six tenths of the ids."""
    s = submission_scores(events)
    return s.filter(F.col("id").cast("bigint") % 10 < 6)


def scores_new(events: DataFrame) -> DataFrame:
    """Two to four polls of six tenths of the ids (a third of them not stored), 20 minutes apart.

    Their scores follow patterns such as A, B, A and A, B, B.
    """
    s = submission_scores(events)
    d, k = F.col("id").cast("bigint"), F.col("k")
    first = F.when(d % 3 == 0, 5).otherwise(0)
    second = F.when(d % 5 == 0, 9).otherwise(first)
    add = F.when(k == 1, second).when((k == 2) & (d % 2 == 0), second).otherwise(first)
    polls = s.filter(d % 10 >= 4).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), 1 + d % 3)))
    return polls.select(
        "id", (F.col("timestamp") + 1200 * (k + 1)).alias("timestamp"), "upvote_ratio", "ups",
        (F.col("score") + add).cast("int").alias("score"), "num_comments")


def polled_posts(events: DataFrame) -> DataFrame:
    """Posts dealt over the eight polled communities and two that are not polled."""
    names = F.array(*[F.lit(c) for c in ("wallstreetbets", "bitcoin", "stocks", "StockMarket", "investing",
                                         "cryptocurrency", "ethereum", "altcoin", "Bitcoin", "options")])
    return submissions(events).withColumn("subreddit", F.get(names, (F.col("id").cast("bigint") % 10).cast("int")))


def raw_posts(documents: DataFrame) -> DataFrame:
    title = F.substring("text", 1, 40)
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        title.alias("title"),
        F.col("text").alias("selftext"),
        (F.lit(1704067200) + F.col("doc_id") * 600).cast("bigint").alias("created"),
        F.char_length("text").alias("selftext_length"),
        F.char_length(title).alias("title_length"),
    )


def poll_batch(documents: DataFrame) -> DataFrame:
    """raw_posts plus the poll time and the metrics a poll returns."""
    d = F.col("id").cast("bigint")
    return raw_posts(documents).select(
        "*",
        (F.col("created") + 1200).alias("polled_at"),
        ((d * 7 % 100).cast("double") / 100).alias("upvote_ratio"),
        (d % 50).cast("int").alias("ups"),
        (d % 50 - 5).cast("int").alias("score"),
        (d % 13).cast("int").alias("num_comments"))


# Posts created before this were scored with the current scorer version.
SCORED_BEFORE = 1704067200 + 2 * 86400
OLD_VERSION = "SentimentAnalyzer_v0"


def stored_sentiments(documents: DataFrame) -> DataFrame:
    """Sentiment rows of an earlier run: older posts carry the current hash,
    newer ones the hash of an older scorer version (so they are re-scored)."""
    from moodcast.operators.ingest import scoring_gate
    p = scoring_gate(raw_posts(documents))
    ver = F.when(F.col("created") < SCORED_BEFORE, F.lit("SentimentAnalyzer_v1")).otherwise(F.lit(OLD_VERSION))
    return p.select(
        "id", F.sha2(F.concat(ver, F.col("title"), F.col("selftext")), 256).alias("hash_check"),
        F.lit(AS_OF - 86400).cast("bigint").alias("updated_timestamp"),
        F.lit(0.0).alias("sentiment_value"))


# The test lexicon of FIXTURES.md (function words, since the
# synthetic prose has no real sentiment words), in this order.
TEST_LEXICON = [("the", 1.5), ("and", -0.8), ("that", -1.9), ("for", 0.6)]


def lexicon(spark: SparkSession) -> DataFrame:
    # as VALUES, so that Spark knows its size as it does of a table in files
    rows = ", ".join(f"('{word}', {valence!r}D)" for word, valence in TEST_LEXICON)
    return spark.sql(f"select * from values {rows} as t(word, valence)")


# The replacement of FIXTURES.md for each remainder of the id by ten,
# in this order; together they reach every polarity rule.
RULE_WORDS = [
    (" the ", " not the "), (" the ", " very the "), (" the ", " VERY the "),
    (" the ", " never so the "), (" and ", " but "), (" the ", " least the "),
    (" the ", " sort of the "), (" the ", " the bomb "), (" the ", " THE "), (" the ", " for very the "),
]


def rule_posts(documents: DataFrame) -> DataFrame:
    """raw_posts whose bodies hold negations, degree words, "but", idioms and capitals."""
    body, kind = F.col("selftext"), F.col("id").cast("bigint") % 10
    out = body
    for i, (old, new) in enumerate(RULE_WORDS):
        out = F.when(kind == i, F.replace(body, F.lit(old), F.lit(new))).otherwise(out)
    return raw_posts(documents).withColumn("selftext", out)


PHRASE_WORDS = (1, 2, 3, 5)


def phrase_lexicon(benchmark: DataFrame) -> DataFrame:
    """All runs of 1, 2, 3 and 5 words of the benchmark texts (words of two or more letters), with a value from their length."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N} ]+", ""), " "), lambda w: F.length(w) > 1)

    def runs(n: int) -> Column:
        return F.transform("w", lambda w, i: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, n), " ")))

    return (benchmark.select(words.alias("w")).select(F.explode(F.concat(*map(runs, PHRASE_WORDS))).alias("phrase")).where("phrase is not null")
            .distinct().withColumn("valence", (F.length("phrase") % 9 - 4).cast("double") / 2))


class Fixture:
    """Lazily derived fixture tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # one DataFrame per input file (listing and footer read once per query)
        if name not in self._tables:
            self._tables[name] = load(self.spark, self.sf_dir, name)
        return self._tables[name]

    @property
    def events(self):
        return self.table("events")

    @property
    def documents(self):
        return self.table("documents")

    def submissions(self):
        return submissions(self.events)

    def scores(self):
        return submission_scores(self.events)

    def sentiments(self):
        return submission_sentiments(self.events)

    def finance_indexes(self):
        return finance_indexes(self.events)

    def price_pages(self):
        return price_pages(self.events)

    def price_archive(self):
        return price_archive(self.events)

    def phrase_lexicon(self):
        return phrase_lexicon(self.table("benchmark"))

    def scores_old(self):
        return scores_old(self.events)

    def scores_new(self):
        return scores_new(self.events)

    def polled_posts(self):
        return polled_posts(self.events)

    def raw_posts(self):
        return raw_posts(self.documents)

    def rule_posts(self):
        return rule_posts(self.documents)

    def lexicon(self):
        if "_lexicon" not in self._tables:
            self._tables["_lexicon"] = lexicon(self.spark)
        return self._tables["_lexicon"]

    def poll_batch(self):
        return poll_batch(self.documents)

    def stored_sentiments(self):
        return stored_sentiments(self.documents)
