"""TXT-5: lexicons of phrases, any number of words long, from an input table.

The phrase table is read as a trie of two levels: ``heads`` holds the first two words
of every phrase (the only word of a single one) with the lengths that go on from there, the
phrase table itself the whole phrases. Each token looks its head up; only tokens with a
head try the few lengths listed there:

  sentences --explode--> one row per token with the words up to the longest phrase
       --join heads--> tokens where a phrase may begin, with its lengths
       --explode lengths, join phrases--> matches
       --group by token, partial then final--> the longest match at each token

Both tables are joined by equality: Spark broadcasts them below its threshold
and shuffles them beyond it, and no phrase is written into the plan. A row carries
at most ``longest`` words, one number that a scalar subquery reads from the table.

Defined cases: words are compared in lower case, without outer punctuation; NULL or
empty phrases and those without a value match nothing; a repeated phrase counts once with its
strongest value (the positive one of two equal); a phrase never crosses a sentence's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodcast.operators import text as T


def _words(c) -> Column:
    return F.transform(T.token_array(c), F.lower)


def phrase_table(phrases: DataFrame) -> DataFrame:
    """(phrase, n_words, valence), each phrase once, in the form that tokens are compared in."""
    words = phrases.where("phrase is not null and valence is not null").select(
        _words(F.regexp_replace(F.trim("phrase"), r"\s+", " ")).alias("w"), "valence").where(F.size("w") > 0)
    return (words.select(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n_words"), "valence")
            .groupBy("phrase", "n_words").agg(F.max(F.struct(F.abs("valence").alias("a"), "valence")).alias("s"))
            .select("phrase", "n_words", F.col("s.valence").alias("valence")))


def _heads(table: DataFrame) -> DataFrame:
    """(head, lengths): the first two words of phrases, or one, and how long phrases with that head are."""
    head = F.substring_index("phrase", " ", 2)
    return table.groupBy(head.alias("head")).agg(F.collect_set("n_words").alias("lengths"))


def phrase_matches(sents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, sent_idx, pos, n_words, phrase, valence): the longest phrase at each token, pos from 0.

    ``sents`` is (id, sent_idx, sentence); keys must be unique.
    """
    table = phrase_table(phrases)
    longest = table.agg(F.coalesce(F.max("n_words"), F.lit(1))).scalar()
    toks = sents.select("id", "sent_idx", _words("sentence").alias("_w")).withColumn("_longest", longest)
    following = F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1)))
    at = toks.select("id", "sent_idx", F.posexplode(F.arrays_zip(
        F.col("_w").alias("w"), following.alias("w2"),
        F.transform("_w", lambda w, i: F.slice(F.col("_w"), i + 1, F.col("_longest"))).alias("ahead"))).alias("pos", "t"))
    # a token may begin with a head of two words and with a phrase of one
    two = F.concat_ws(" ", "t.w", "t.w2")
    begins = at.select("id", "sent_idx", "pos", F.col("t.ahead").alias("_ahead"), F.explode(
        F.when(F.col("t.w2").isNull(), F.array("t.w")).otherwise(F.array(F.col("t.w"), two))).alias("head"))
    tried = (begins.join(_heads(table), "head").select("id", "sent_idx", "pos", "_ahead", F.explode("lengths").alias("n_words"))
             .where(F.col("n_words") <= F.size("_ahead"))
             .select("id", "sent_idx", "pos", "n_words", F.array_join(F.slice("_ahead", 1, F.col("n_words")), " ").alias("phrase")))
    found = tried.join(table, ["phrase", "n_words"])
    best = F.max(F.struct("n_words", "phrase", "valence")).alias("m")
    return found.groupBy("id", "sent_idx", "pos").agg(best).select("id", "sent_idx", "pos", "m.*")


def without_overlaps(matches: DataFrame) -> DataFrame:
    """The matches that remain when a sentence is read from its start and each match skips its own words.

    Matches are first cut into runs that overlap no other run; only a run is folded by one expression.
    """
    sentence = Window.partitionBy("id", "sent_idx").orderBy("pos")
    before = F.max(F.col("pos") + F.col("n_words")).over(sentence.rowsBetween(Window.unboundedPreceding, -1))
    runs = matches.withColumn("_new", F.coalesce(F.col("pos") >= before, F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(sentence))
    rows = F.array_sort(F.collect_list(F.struct("pos", "n_words", "phrase", "valence")))
    folded = runs.groupBy("id", "sent_idx", "_run").agg(rows.alias("_m"))
    first = F.slice("_m", 1, 1)

    def take(kept: Column, m: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when(m["pos"] >= last["pos"] + last["n_words"], F.concat(kept, F.array(m))).otherwise(kept)

    kept = F.aggregate(F.slice("_m", 2, F.greatest(F.size("_m") - 1, F.lit(0))), first, take)
    return folded.select("id", "sent_idx", F.inline(kept))
