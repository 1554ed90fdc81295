"""The memo of sentence polarities: equal results, only unseen sentences scored."""

import pytest
from pyspark.sql import functions as F

from moodcast import schemas as S
from moodcast.operators import text as T
from moodcast.operators.memo import (memo_version, sentence_hash, sentence_refs, sentiment_from_memo,
                                     text_sentiment_memo, unseen_polarities)
from moodcast.plans.ingest_job import run_ingest
from moodcast.sources import fixtures as FX
from moodcast.sources.store import TableStore
from moodcast.sources.tables import load, read_table
from tests.conftest import SF_SMALL, rows

TEXTS = [None, "", " ... ", "the end. and then! the end.", "THE one that is not the other.\nand so on", "the end.",
         "nothing here", "the end. " * 300]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def empty(spark):
    return spark.createDataFrame([], S.SENTENCE_MEMO)


def test_equals_plain_scoring(spark):
    df, lex = frame(spark), FX.lexicon(spark)
    got, fresh = text_sentiment_memo(df, "id", "text", lex, empty(spark), "v")
    assert rows(got, "id", "n_sentences", "sentiment") == rows(T.text_sentiment(df, "id", "text", lex))
    hashes = [r["hash"] for r in fresh.collect()]
    assert len(hashes) == len(set(hashes)) == 5      # "the end." is in three texts, once in the memo


@pytest.mark.parametrize("hot", [1, 2, 4096])
def test_known_sentences_are_not_scored(spark, hot):
    """A memo with values of its own shows which polarities were looked up, hot ones and others."""
    df, lex = frame(spark), FX.lexicon(spark)
    refs = sentence_refs(df, "id", "text")
    memo = spark.createDataFrame([("the end.", 0.5), ("nothing here", -0.25)], "s string, polarity double").select(
        F.lit("v").alias("version"), sentence_hash("s").alias("hash"), "polarity")
    memo = memo.unionByName(memo)     # a retried append
    fresh = unseen_polarities(df, "text", refs, lex, memo, "v")
    assert fresh.count() == 3
    got = {r["id"]: r["sentiment"] for r in sentiment_from_memo(refs, memo.unionByName(fresh), "v", hot=hot).collect()}
    assert got[5] == 0.5 and got[6] == -0.25 and abs(got[7] - 0.5) < 1e-12
    assert got[0] is None and got[1] is None and got[2] is None
    # rows of another version are not used, and a missing polarity is no zero
    lacking = {r["id"]: r["sentiment"] for r in sentiment_from_memo(refs, memo, "v", hot=hot).collect()}
    assert lacking[5] == 0.5 and lacking[3] is None
    assert unseen_polarities(df, "text", refs, lex, memo, "w").count() == 5


def test_clashing_names_and_carry(spark):
    df = frame(spark).select("id", "text", F.lit(1).alias("hash"), F.lit("x").alias("polarity"), F.lit(2).alias("version"))
    got, _ = text_sentiment_memo(df, "id", "text", FX.lexicon(spark), empty(spark), "v", carry=["polarity"])
    assert {r["polarity"] for r in got.collect()} == {"x"} and got.count() == len(TEXTS)


def test_empty_tables(spark):
    df = frame(spark).limit(0)
    got, fresh = text_sentiment_memo(df, "id", "text", FX.lexicon(spark), empty(spark), "v")
    assert got.count() == 0 and fresh.count() == 0


def test_version_follows_lexicon_and_rules(spark):
    lex = FX.lexicon(spark)
    v = memo_version(lex)
    assert v == memo_version(lex.orderBy(F.desc("word")).unionByName(lex))
    assert v != memo_version(lex, T.BASE)
    assert v != memo_version(lex.withColumn("valence", F.col("valence") + F.when(F.col("word") == "the", 0.1).otherwise(0.0)))
    assert memo_version(lex.limit(0)) != v


def test_ingest_keeps_a_memo(spark, tmp_root):
    """Edited posts score only their new sentences; the tables equal those without a memo."""
    lex = FX.lexicon(spark)
    batch = FX.poll_batch(load(spark, SF_SMALL, "documents"))
    edited = batch.where("id % 3 = 0").withColumns({
        "selftext": F.concat("selftext", F.lit("\nthe edit that came later and stays.")),
        "polled_at": F.col("polled_at") + 600})
    store = TableStore(f"{tmp_root}/memo")
    plain = f"{tmp_root}/plain"
    for k, b in enumerate((batch, edited, edited)):
        run_ingest(spark, store, b, lex, FX.AS_OF + k, f"b{k}", memo=True)
        run_ingest(spark, plain, b, lex, FX.AS_OF + k, f"b{k}")
        memo = read_table(spark, store.path("sentence_memo"), S.SENTENCE_MEMO)
        if k == 0:
            before = memo.count()
    assert memo.count() == before + 1
    stored = store.read(spark, "submission_sentiments", S.SUBMISSION_SENTIMENTS)
    want = read_table(spark, f"{plain}/submission_sentiments", S.SUBMISSION_SENTIMENTS)
    assert rows(stored) == rows(want) and stored.count() > 0


def test_unseen_sentences_are_scored_once(spark):
    """The rows to append are staged: what looks them up twice reads no text."""
    from __spark_entry__ import queries
    from tests.test_plans import plan
    assert "documents.parquet" not in plan(queries()["q_memo_sentiment"](spark, SF_SMALL))


def test_sentences_meet_before_they_are_hashed(spark):
    """Equal sentences are one row before their hash is made, and what they are joined with is dealt over all cores."""
    from tests.test_plans import plan
    df = frame(spark)
    p = plan(unseen_polarities(df, "text", sentence_refs(df, "id", "text"), FX.lexicon(spark), empty(spark), "v"))
    assert "keys=[sentence#" in p and "keys=[hash#" in p
    assert not [x for x in p.splitlines() if "keys=[hash#" in x and "sentence#" in x.split("keys=[")[1].split("]")[0]]
    assert f", {T.even_tasks(df)})" in p and "REPARTITION_BY_NUM" in p
