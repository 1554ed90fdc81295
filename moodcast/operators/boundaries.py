"""Learned sentence boundaries (TXT-1): abbreviations found without labels (Kiss & Strunk 2006).

A token that nearly always carries a final period, more often than the share of
periods in the text explains, is an abbreviation. One aggregate over all tokens
counts each type with and without the period; the score is the log-likelihood ratio of both
hypotheses, weighted by length, inner periods and the times the type stands without
its period. The splitter reads the learned table: after an abbreviation no
sentence ends, unless the next word is a frequent sentence starter written with
a capital.

Starters are words that follow a sentence end more often than their share of
all words explains (log-likelihood ratio above ``STARTER_SCORE``), counted after the
periods of types that are no abbreviations.

Texts are read token by token in the map tasks; what is shuffled are counts by
type. A newline ends a sentence always, as in the rule-based splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodcast.operators.text import BLANKS_RE, CONTENT_RE, END_RE

# Thresholds of the published method.
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
PERIOD_RATE = 0.99      # of a true abbreviation
EDGE = "[^a-z0-9.]"     # signs around a lower-cased token that are not part of its type


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, BLANKS_RE, " "), "\n")


def _bare(token: Column) -> Column:
    """Lower-cased token without signs around it; a final period stays."""
    return F.regexp_replace(F.lower(token), f"^({EDGE})+|({EDGE})+$", "")


def token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, period, next, n): tokens of each type with and without a final period; after a period also the next
    word's type (empty at the end of a line), which is NULL elsewhere so that the table stays small.

    Tokens are first counted as they are written, in the map tasks; the patterns then read each distinct one once.
    A job that reads the counts more than once stages them, so that the texts are read once.
    """
    ends_lines = F.replace(F.regexp_replace(F.col(text_col), BLANKS_RE, " "), F.lit("\n"), F.lit(" \n "))   # an end is a token
    toks = df.select(F.filter(F.split(ends_lines, " "), lambda t: t != "").alias("_toks"))
    # each token with the next one, kept only where a period may stand before it: one array, exploded once
    pairs = F.arrays_zip(F.col("_toks").alias("token"), F.slice("_toks", 2, F.greatest(F.size("_toks"), F.lit(1))).alias("next"))
    raw = (toks.select(F.explode(pairs).alias("p")).where(F.col("p.token") != "\n")
           .select(F.lower("p.token").alias("token"), F.when(F.contains("p.token", F.lit(".")), F.lower("p.next")).alias("next"))
           .groupBy("token", "next").agg(F.count("*").alias("n")))
    # the condition names the count, so that it is tested on the counted tokens, not on every one before
    rows = (raw.select(_bare(F.col("token")).alias("token"), F.coalesce(_bare(F.col("next")), F.lit("")).alias("next"), "n")
            .where(F.when(F.col("n") > 0, F.col("token").rlike("[a-z0-9]"))))
    period = F.col("token").endswith(".")
    return (rows.select(F.regexp_replace("token", r"\.+$", "").alias("type"), period.alias("period"),
                        F.when(period, F.regexp_replace("next", r"\.+$", "")).alias("next"), "n")
            .groupBy("type", "period", "next").agg(F.sum("n").alias("n")))


def _xlog(k: Column, p: Column) -> Column:
    """k * ln(p), 0 where k is 0."""
    return F.when(k > 0, k * F.ln(p)).otherwise(F.lit(0.0))


def learned_abbreviations(counts: DataFrame, threshold: float = ABBREVIATION_SCORE) -> DataFrame:
    """(type, n, n_period, score) of the types with a letter whose score reaches ``threshold``."""
    types = counts.where("type rlike '[a-z]'").groupBy("type").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("n_period"))
    ended = F.sum(F.when(F.col("period"), F.col("n")).otherwise(0))
    t = types.where("n_period > 0").withColumn("_rate", counts.agg(ended / F.sum("n")).scalar())   # one number
    rate = F.col("_rate")
    without = F.col("n") - F.col("n_period")
    chance = _xlog(F.col("n_period"), rate) + _xlog(without, 1 - rate)
    abbreviation = _xlog(F.col("n_period"), F.lit(PERIOD_RATE)) + _xlog(without, F.lit(1 - PERIOD_RATE))
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    inner = F.length("type") - letters + 1
    score = -2 * (chance - abbreviation) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -without)
    return t.withColumn("score", score).where(F.col("score") >= threshold).select("type", "n", "n_period", "score")


def learned_starters(counts: DataFrame, abbreviations: DataFrame, threshold: float = STARTER_SCORE) -> DataFrame:
    """(word, n_after, score): words after a period of no abbreviation, with Dunning's ratio above ``threshold``."""
    words = counts.groupBy(F.col("type").alias("word")).agg(F.sum("n").alias("n"))
    after = (counts.where("period and next <> ''").join(abbreviations.select("type"), "type", "left_anti")
             .groupBy(F.col("next").alias("word")).agg(F.sum("n").alias("n_after")))
    t = (after.join(words, "word").withColumn("_n", words.agg(F.sum("n")).scalar())
         .withColumn("_a", after.agg(F.sum("n_after")).scalar()))   # one number each
    k, a, n, total = F.col("n_after"), F.col("_a"), F.col("n"), F.col("_n")
    p, p1, p2 = n / total, k / a, (n - k) / (total - a)

    def likelihood(hits: Column, tries: Column, rate: Column) -> Column:
        return _xlog(hits, rate) + _xlog(tries - hits, 1 - rate)

    score = -2 * (likelihood(k, a, p) + likelihood(n - k, total - a, p) - likelihood(k, a, p1) - likelihood(n - k, total - a, p2))
    return (t.where((k <= a) & (n >= k) & (total > a)).withColumn("score", score)
            .where((F.col("score") > threshold) & (p1 > p)).select("word", "n_after", "score"))


def learned_sentences(df: DataFrame, id_col: str, text_col: str, abbreviations: DataFrame, starters: DataFrame) -> DataFrame:
    """(id, sent_idx, sentence): the rule-based parts of each line, joined again where the learned tables say so.

    Both look-ups are joins on the last and the next word of a part, broadcast or shuffled by
    Spark's estimate; the window orders one text's parts.
    """
    parts = F.flatten(F.transform(_lines(F.col(text_col)), lambda x, i: F.transform(
        F.filter(F.transform(F.split(F.regexp_replace(x, END_RE, "$1\n"), "\n"), lambda s: F.trim(s)),
                 lambda s: s != ""), lambda s: F.struct(i.alias("line"), s.alias("part")))))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("at", "p")).select("id", "at", "p.line", "p.part")
    by_text = Window.partitionBy("id").orderBy("at")
    last = _bare(F.element_at(F.split("part", " "), -1))
    first = F.element_at(F.split("part", " "), 1)
    known = rows.withColumn("type", F.when(last.endswith("."), F.regexp_replace(last, r"\.+$", ""))).withColumn(
        "word", F.when(first.rlike("^[^a-zA-Z0-9]*[A-Z]"), F.regexp_replace(_bare(first), r"\.+$", "")))
    known = (known.join(abbreviations.select("type", F.lit(True).alias("abbreviated")), "type", "left")
             .join(starters.select("word", F.lit(True).alias("starts")), "word", "left"))
    joins = (F.lag("abbreviated").over(by_text).eqNullSafe(True) & F.col("starts").isNull()
             & F.lag("line").over(by_text).eqNullSafe(F.col("line")))
    grouped = (known.withColumn("_begins", F.when(joins, 0).otherwise(1))
               .withColumn("_sentence", F.sum("_begins").over(by_text)).groupBy("id", "_sentence")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ")
                    .alias("sentence")).where(F.col("sentence").rlike(CONTENT_RE)))
    return grouped.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("_sentence")) - 1).alias("sent_idx"), "sentence")
