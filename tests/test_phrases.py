"""Phrase lexicons: longest match at each token, overlaps, against a plain version."""

import random

from moodcast.operators.phrases import phrase_matches, without_overlaps
from tests.conftest import rows
from tests.test_plans import plan

PHRASES = [("kiss of death", -1.5), ("kiss", 1.0), ("kiss of", 0.5), ("The  Bomb!", 3.0), ("the bomb", -3.0), ("of death and", 2.0),
           (None, 1.0), ("", 1.0), ("no value", None), ("cut the mustard on a long day", 2.0)]


def sents(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, sent_idx int, sentence string")


def table(spark, pairs=PHRASES):
    return spark.createDataFrame(pairs, "phrase string, valence double")


def test_by_hand(spark):
    got = phrase_matches(sents(spark, "A kiss of death, and the Bomb.", "kiss of", "Kiss kiss of", "they cut the mustard on no day",
                               "no value here", "", None), table(spark))
    # one-letter words are no tokens
    assert rows(got) == [(0, 0, 0, 3, "kiss of death", -1.5), (0, 0, 1, 3, "of death and", 2.0), (0, 0, 4, 2, "the bomb", 3.0),
                         (1, 0, 0, 2, "kiss of", 0.5), (2, 0, 0, 1, "kiss", 1.0), (2, 0, 1, 2, "kiss of", 0.5)]
    assert rows(without_overlaps(got), "id", "pos") == [(0, 0), (0, 4), (1, 0), (2, 0), (2, 1)]


def test_plain_version(spark):
    rnd = random.Random(7)
    words = ["aa", "bb", "cc", "dd"]
    phrases = {" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 4, 6]))) for _ in range(60)}
    texts = [" ".join(rnd.choices(words + ["zz"], k=rnd.randrange(0, 40))) for _ in range(40)]
    want, alone = [], []
    for i, t in enumerate(texts):
        toks, end = t.split(), 0
        for p in range(len(toks)):
            hits = [n for n in (6, 4, 3, 2, 1) if p + n <= len(toks) and " ".join(toks[p:p + n]) in phrases]
            if hits:
                want.append((i, 0, p, hits[0], " ".join(toks[p:p + hits[0]]), 1.0))
                if p >= end:
                    alone.append(want[-1])
                    end = p + hits[0]
    got = phrase_matches(sents(spark, *texts), table(spark, [(p, 1.0) for p in phrases]))
    assert rows(got) == sorted(want)
    assert rows(without_overlaps(got)) == sorted(alone)


def test_ten_thousand_phrases_and_no_literals(spark):
    many = spark.range(10000).selectExpr("concat('word', id, ' stands by word', id + 1) as phrase", "cast(id as double) as valence")
    got = phrase_matches(sents(spark, " ".join(f"word{i} stands by" for i in range(0, 10000))), many)
    assert got.count() == 9999
    assert "word77 stands" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_empty_tables(spark):
    assert phrase_matches(sents(spark, "kiss of death"), table(spark).limit(0)).count() == 0
    got = phrase_matches(sents(spark, "kiss of death").limit(0), table(spark))
    assert got.count() == 0 and without_overlaps(got).count() == 0


def test_heads_are_built_without_a_function_for_each_token(spark):
    p = plan(phrase_matches(sents(spark, "the bomb"), table(spark)))
    assert "array_distinct" not in p and "concat_ws" in p
