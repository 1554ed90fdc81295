"""Text scoring rules (TXT-1..5) on hand-written sentences."""

import math

import pytest

from moodcast.operators import text as T

LEX = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("the", 1.5), ("greatly", 1.1), ("bomb", -2.2),
       ("kind", 2.4), ("well", 1.1)]


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame(LEX, "word string, valence double")


def score(spark, lex, text, rules=T.FULL):
    df = spark.createDataFrame([("x", text)], "id string, text string")
    r = T.text_sentiment(df, "id", "text", lex, rules).first()
    return r.sentiment, r.n_sentences


def comp(x):
    return round(x / math.sqrt(x * x + 15), 4)


# Worked by hand from the published method: (text, sum of the token values).
BY_HAND = [
    ("it was very good", 1.9 + 0.293),
    ("it was VERY good", 1.9 + (0.293 + 0.733)),
    ("it was VERY bad", -2.5 + (-0.293 - 0.733)),
    ("never so good", (1.9 + 0.293) * 1.5),
    ("never this was good", 1.9 * 1.25),             # "never this" two words before: emphasis
    ("never that was good", 1.9 * -0.74),
    ("never so utterly good", ((1.9 + 0.293) + 0.293 * 0.95) * 1.25),
    ("he is all so good", (1.9 + 0.293) * 1.25),
    ("greatly good", 0 + 1.9),                      # "greatly" is in the lexicon: it modifies nothing
    ("remarkably good", 1.9 + 0.293),
    ("not GOOD", (1.9 + 0.733) * -0.74),
    ("it isn't, good", 1.9 * -0.74),
    ("kind-of good", 1.9 - 0.293),
    ("it is sort of good", 1.9 - 0.293),
    ("it is kind of good", 1.9 - 0.293),            # "kind" before "of" scores nothing itself
    ("a kind man", 2.4),
    ("it is simply the bomb", 3.0 + 3.0),           # each lexicon word of an idiom gets its valence
    ("that was uh-uh good", 1.9 * -0.74),
    ("no good", 1.9),                               # "no" is no negation word of this version
    ("good, but (bad)!", 1.9 * 0.5 - 2.5 * 1.5 - 0.292),
    ('"good" well...', 1.9 + 1.1),
]


def test_rules_by_hand(spark, lex):
    df = spark.createDataFrame([(t,) for t, _ in BY_HAND], "text string")
    got = {r.id: (r.sentiment, r.n_sentences) for r in T.text_sentiment(df, "text", "text", lex).collect()}
    assert got == {t: (pytest.approx(comp(total), abs=1e-9), 1) for t, total in BY_HAND}


def test_repeated_lexicon_words_count_once(spark):
    lex = spark.createDataFrame([(":p", 1.4), (":p", -0.5)], "word string, valence double")
    assert score(spark, lex, "nice :p") == (pytest.approx(comp(1.4), abs=1e-9), 1)


@pytest.mark.parametrize("text,n", [
    ("Cointelegraph News https://cointelegraph.com/news/riot-platforms-add-bitcoin-miners-ahead-of-2024-halving", 1),
    ("The index rose 3.5 points to 1,012.50 today.", 1),
    ("The U.S. index rose 3.5 points to 1,012.50 today.", 2),
    ('He said "stop!" Then he left. . . (Really?) Yes', 4),
    ("... !!! ?", 0), ("", 0), ("\n\n", 0), ("one\ntwo", 2),
])
def test_sentence_counts(spark, lex, text, n):
    assert score(spark, lex, text)[1] == n


def test_spread_and_long_lexicons_change_nothing(spark, lex):
    """The same rows with the words dealt over tasks and a join that shuffles."""
    rows = [(str(i), t) for i, (t, _) in enumerate(BY_HAND)] + [("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    want = sorted(map(tuple, T.text_sentiment(df, "id", "text", lex).collect()))
    got = sorted(map(tuple, T.text_sentiment(df, "id", "text", lex.hint("merge"), spread=3).collect()))
    assert got == want and len(want) == len(rows)


def test_base_compound(spark, lex):
    assert score(spark, lex, "It is good.")[0] == comp(1.9)


def test_negation_flips(spark, lex):
    s, _ = score(spark, lex, "It is not good", T.Rules(negation=True, degree=False, caps=False,
                                                        but=False, punctuation=False))
    assert s == comp(1.9 * T.N_SCALAR)


def test_negation_within_three_words(spark, lex):
    only_neg = T.Rules(True, False, False, False, False)
    assert score(spark, lex, "never was it good", only_neg)[0] == comp(1.9 * T.N_SCALAR)
    assert score(spark, lex, "never was it really good", only_neg)[0] == comp(1.9)


def test_degree_word(spark, lex):
    only_deg = T.Rules(False, True, False, False, False)
    assert score(spark, lex, "very good", only_deg)[0] == comp(1.9 + T.B_INCR)
    assert score(spark, lex, "very bad", only_deg)[0] == comp(-2.5 - T.B_INCR)
    assert score(spark, lex, "very much good", only_deg)[0] == comp(1.9 + T.B_INCR * 0.95)


def test_caps_only_in_mixed_case(spark, lex):
    caps = T.Rules(False, False, True, False, False)
    assert score(spark, lex, "it is GOOD", caps)[0] == comp(1.9 + T.C_INCR)
    assert score(spark, lex, "IT IS GOOD", caps)[0] == comp(1.9)


def test_but_weighting(spark, lex):
    but = T.Rules(False, False, False, True, False)
    assert score(spark, lex, "good but bad", but)[0] == comp(1.9 * 0.5 - 2.5 * 1.5)


def test_exclamation_and_question_marks(spark, lex):
    p = T.Rules(False, False, False, False, True)
    assert score(spark, lex, "good!!", p)[0] == comp(1.9 + 2 * T.EXCL_WEIGHT)
    assert score(spark, lex, "good!!!!!!", p)[0] == comp(1.9 + 4 * T.EXCL_WEIGHT)
    assert score(spark, lex, "good??", p)[0] == comp(1.9 + 2 * T.QM_WEIGHT)
    assert score(spark, lex, "good????", p)[0] == comp(1.9 + T.QM_MAX_AMP)
    assert score(spark, lex, "good?", p)[0] == comp(1.9)


def test_mean_counts_neutral_sentences(spark, lex):
    s, n = score(spark, lex, "It is good. Nothing here. Also nothing", T.BASE)
    assert n == 3 and s == pytest.approx(comp(1.9) / 3, abs=1e-9)


def test_no_sentence_is_null(spark, lex):
    assert score(spark, lex, "   ")[0] is None
    assert score(spark, lex, None) == (None, 0)


def test_sentences_split(spark):
    df = spark.createDataFrame([("x", "Hello world. Foo!! bar?\n\n  baz")], "id string, text string")
    got = [r.sentence for r in T.sentences(df, "id", "text").orderBy("sent_idx").collect()]
    assert got == ["Hello world.", "Foo!!", "bar?", "baz"]


def test_one_char_tokens_dropped_and_polarity_bounded(spark, lex):
    df = spark.createDataFrame([("x", "a good " * 200)], "id string, text string")
    r = T.sentence_polarity(df, "id", "text", lex).first()
    assert -1 < r.polarity < 1 and r.polarity > 0.99


def test_carry_columns(spark, lex):
    df = spark.createDataFrame([("x", "good. bad.", "h1"), ("y", "", "h2")], "id string, text string, h string")
    got = {r.id: r for r in T.text_sentiment(df, "id", "text", lex, carry=["h"]).collect()}
    assert got["x"].h == "h1" and got["y"].h == "h2" and got["y"].sentiment is None


def test_degree_word_scores_zero_itself(spark, lex):
    only_deg = T.Rules(False, True, False, False, False)
    assert score(spark, lex, "greatly", only_deg)[0] == 0.0
    assert score(spark, lex, "greatly", T.BASE)[0] == comp(1.1)


def test_least_rule(spark, lex):
    only_neg = T.Rules(True, False, False, False, False)
    assert score(spark, lex, "the least good", only_neg)[0] == comp(1.5 + 1.9 * T.N_SCALAR)
    assert score(spark, lex, "at least good", only_neg)[0] == comp(1.9)


def test_emoticon_tokens_match_lexicon(spark):
    lex = spark.createDataFrame([(":)", 2.0), (":(", -1.9)], "word string, valence double")
    df = spark.createDataFrame([("x", "nice day :) really")], "id string, text string")
    assert T.text_sentiment(df, "id", "text", lex, T.BASE).first().sentiment == comp(2.0)


@pytest.mark.parametrize("text,total", [
    ("GOOD 42", 1.9 + 0.733), ("GOOD A", 1.9), ("GOOD (BAD)", 1.9 - 2.5), ("Good x GOOD", 1.9 + 1.9 + 0.733),
    ('good, "BUT" bad', 1.9 * 0.5 - 2.5 * 1.5), ("butter, good", 1.9), ("good butter But, bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("x y good", 1.9), ("'not' a (good)", 1.9 * -0.74), ("A B", 0.0), ("\u00c9T\u00c9 good", 1.9),
])
def test_sentence_features(spark, lex, text, total):
    """Upper-case tokens and "but" count as stripped tokens of two or more characters; an empty word matches none."""
    odd = lex.unionByName(spark.createDataFrame([("", 2.0)], "word string, valence double"))
    assert score(spark, odd, text) == (pytest.approx(comp(total), abs=1e-9), 1)


def test_tokens_become_rows_without_a_lambda(spark, lex):
    """Tokens are exploded as they are: no struct is built for each of them, before it is known to be a lexicon word."""
    from tests.test_plans import plan
    df = spark.createDataFrame([("x", "good")], "id string, text string")
    p = plan(T.text_sentiment(df, "id", "text", lex))
    assert "posexplode(_toks" in p and "explode(transform(_toks" not in p


def test_generated_methods_are_small_enough_to_compile(spark, lex):
    """The JVM interprets methods of more than 8,000 bytes."""
    import re
    df = spark.createDataFrame([("x", "good")], "id string, text string")
    debug = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug
    q = T.text_sentiment(df, "id", "text", lex)._jdf.queryExecution()
    code = getattr(getattr(debug, "package$"), "MODULE$").codegenString(q.executedPlan())
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert max(sizes, default=0) < 8000
