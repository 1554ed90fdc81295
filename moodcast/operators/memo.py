"""Memo of sentence polarities (TXT-2, TXT-3, SNK-5).

A sentence's polarity follows from its characters, the lexicon and the rules
alone, so a table ``(version, hash, polarity)`` keeps it across batches and posts: an
edited post costs only its new sentences, a sentence that many posts share is scored once.

  texts --split, hash--> refs: one narrow row per sentence, no text
  refs --distinct--> hashes --anti join--> hashes the memo lacks
  texts --split--> distinct sentences --hash, semi join on those--> scored by the lexicon job
  refs --join with the memo--> group by document, partial then final

Only unseen sentences are shuffled as text. The memo is first cut down to
the hashes of the batch, so what meets the batch is never larger than it. A sentence
may stand in a third of all posts: the ``HOT`` most frequent hashes (a fixed number of
rows) are looked up by broadcast and never enter the shuffled join, so no key
of that join holds more than 1/``HOT`` of the rows.

Defined cases: a NULL text and one without a sentence have 0 sentences and a
NULL sentiment; a document with a sentence that the memo lacks has a NULL
sentiment; repeated memo rows (a retried append) count once; an empty memo or
table gives the plain result or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast import params as P
from moodcast.functions.exprs import col_
from moodcast.operators import text as T

HOT = 4096
METHOD = "sentence-v1"  # raise it when the splitter or a rule changes: the memo starts anew


def sentence_hash(sentence) -> Column:
    """SHA-256 of a sentence (32 bytes)."""
    return F.unhex(F.sha2(col_(sentence), 256))


def memo_version(lexicon: DataFrame, rules: T.Rules = T.FULL) -> str:
    """The key of all polarities under this lexicon and these rules.

    One partial aggregate over the lexicon, whatever the order of its rows; one row comes back.
    """
    row = lexicon.where("word is not null and valence is not null").distinct().agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("word", "valence").cast("decimal(38,0)")), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.xxhash64("valence", "word", F.lit(METHOD)).cast("decimal(38,0)")), F.lit(0)).alias("b")).first()
    flags = "".join(str(int(x)) for x in (rules.negation, rules.degree, rules.caps, rules.but,
                                          rules.punctuation, rules.idioms))
    return f"{METHOD}-{flags}-{row['n']}-{row['a']}-{row['b']}"


def sentence_refs(df: DataFrame, id_col: str, text, carry: list[str] | tuple = (),
                  spread: int | None = None) -> DataFrame:
    """(id, carry..., hash): one row per sentence, with a NULL hash for a document that has none."""
    src = df.select(F.col(id_col).alias("id"), *carry, col_(text).alias("_text"))
    src = src.repartition(spread, "id") if spread else src
    return src.select("id", *carry, F.explode_outer(F.transform(T.sentence_array("_text"), sentence_hash)).alias("hash"))


def _known(memo: DataFrame, version: str, hashes: DataFrame) -> DataFrame:
    """(hash, polarity) of the memo rows of ``version`` that ``hashes`` name, each once."""
    return (memo.where(F.col("version") == version).join(hashes, "hash", "left_semi")
            .groupBy("hash").agg(F.max("polarity").alias("polarity")))


def unseen_polarities(df: DataFrame, text, refs: DataFrame, lexicon: DataFrame, memo: DataFrame, version: str,
                      rules: T.Rules = T.FULL, spread: int | None = None) -> DataFrame:
    """(version, hash, polarity) of the sentences of ``df`` that the memo lacks: the rows to append.

    ``refs`` are those of the same texts (``sentence_refs``), staged by a job that reads them again.
    """
    hashes = refs.where("hash is not null").select("hash").distinct()
    todo = hashes.join(_known(memo, version, hashes).select("hash"), "hash", "left_anti")
    src = df.select(col_(text).alias("_text"))
    src = src.repartition(spread) if spread else src
    # equal sentences meet in the map tasks, as text: what is hashed and joined is each of them once
    texts = src.select(F.explode_outer(T.sentence_array("_text")).alias("sentence")).where("sentence is not null").distinct()
    fresh = texts.select(sentence_hash("sentence").alias("hash"), "sentence").join(
        todo.repartition(T.even_tasks(df), "hash"), "hash", "left_semi")
    scored = T.score_sentences(fresh.select(F.col("hash").alias("id"), F.lit(0).alias("sent_idx"), "sentence"), lexicon, rules)
    return scored.select(F.lit(version).alias("version"), F.col("id").alias("hash"), "polarity")


def sentiment_from_memo(refs: DataFrame, memo: DataFrame, version: str, carry: list[str] | tuple = (),
                        hot: int = HOT) -> DataFrame:
    """TXT-3 by look-up: (id, n_sentences, sentiment[, carry...]), equal to ``text_sentiment``."""
    carry = list(carry)
    found = refs.where("hash is not null").select("id", "hash")
    counts = found.groupBy("hash").agg(F.count("*").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "hash").limit(hot).select("hash")
    known = _known(memo, version, counts.select("hash"))
    hot_known = F.broadcast(known.join(F.broadcast(frequent), "hash", "left_semi"))
    rest = found.join(F.broadcast(frequent), "hash", "left_anti")
    hits = found.join(hot_known, "hash").unionByName(rest.join(known, "hash")).select(
        "id", F.col("polarity").cast(P.POLARITY_DECIMAL).alias("_p"), F.lit(1).alias("_known"), F.lit(0).alias("_n"))
    every = refs.select("id", *carry, F.lit(0).cast(P.POLARITY_DECIMAL).alias("_p"), F.lit(0).alias("_known"),
                        F.col("hash").isNotNull().cast("int").alias("_n"))
    per_doc = every.unionByName(hits, allowMissingColumns=True).groupBy("id").agg(
        F.sum("_p").cast("double").alias("_s"), F.sum("_n").cast("int").alias("n_sentences"),
        F.sum("_known").alias("_known"), *[F.max(c).alias(c) for c in carry])
    whole = F.col("_known") == F.col("n_sentences")
    return per_doc.select("id", "n_sentences",
                          F.when(whole, F.try_divide(F.col("_s"), F.col("n_sentences"))).alias("sentiment"), *carry)


def text_sentiment_memo(df: DataFrame, id_col: str, text, lexicon: DataFrame, memo: DataFrame, version: str,
                        rules: T.Rules = T.FULL, carry: list[str] | tuple = (),
                        spread: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sentiments, memo rows to append): the whole operator in one plan, for callers without a store."""
    refs = sentence_refs(df, id_col, text, carry, spread)
    fresh = unseen_polarities(df, text, refs, lexicon, memo, version, rules, spread)
    return sentiment_from_memo(refs, memo.select("version", "hash", "polarity").unionByName(fresh), version, carry), fresh
