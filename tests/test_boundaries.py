"""Learned abbreviations and the splitter that reads them, on cases worked by hand."""

import math

from __spark_entry__ import queries
from moodcast.operators.boundaries import learned_abbreviations, learned_sentences, learned_starters, token_counts
from tests.conftest import SF_SMALL, rows
from tests.test_plans import plan

WORDS = ("again", "others", "twice", "today", "later")
TEXTS = ["The U.S. index fell by a lot. It rose later.", "He met Dr. Smith today. It was fine."] + [
    f"The number {i} came {WORDS[i % 5]} or {WORDS[i % 4]}. It is what the U.S. bank said to dr. Jones vs. {WORDS[i % 3]} {WORDS[i % 5]}. "
    f"It came {WORDS[i % 5]} and the end of {WORDS[i % 2]} came" for i in range(60)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_scores_follow_the_formula(spark):
    counts = token_counts(frame(spark))
    tokens = [t for x in TEXTS for t in x.lower().split()]
    n, p = len(tokens), sum(t.endswith(".") for t in tokens)
    got = {r["type"]: r for r in learned_abbreviations(counts).collect()}
    for kind in ("u.s", "dr", "vs"):
        full = sum(t == kind + "." for t in tokens)
        bare = sum(t == kind for t in tokens)
        letters = len(kind.replace(".", ""))
        ratio = -2 * (full * math.log(p / n) + bare * math.log(1 - p / n) - full * math.log(0.99) - bare * math.log(0.01))
        want = ratio * math.exp(-letters) * (kind.count(".") + 1) * letters ** -bare
        assert abs(got[kind]["score"] / want - 1) < 1e-9 and (got[kind]["n"], got[kind]["n_period"]) == (full + bare, full)
    assert not {"again", "others", "twice"} & set(got)


def test_splitter(spark):
    df = frame(spark)
    counts = token_counts(df)
    abbreviations = learned_abbreviations(counts)
    starters = learned_starters(counts, abbreviations)
    words = {r["word"] for r in starters.collect()}
    assert "it" in words and "jones" not in words
    got = {}
    for r in learned_sentences(df, "id", "text", abbreviations, starters).collect():
        got.setdefault(r["id"], []).append((r["sent_idx"], r["sentence"]))
    assert sorted(got[0]) == [(0, "The U.S. index fell by a lot."), (1, "It rose later.")]
    assert sorted(got[1]) == [(0, "He met Dr. Smith today."), (1, "It was fine.")]
    assert [s for _, s in sorted(got[5])][1] == "It is what the U.S. bank said to dr. Jones vs. again today."


def test_awkward_texts(spark):
    texts = [None, "", " \n ", "...", "in the U.S.\nindex", "in the U.S. It rose", "a! b? c", "(see vs.) other"]
    learn = frame(spark)
    counts = token_counts(learn)
    abbreviations = learned_abbreviations(counts)
    got = rows(learned_sentences(frame(spark, texts), "id", "text", abbreviations, learned_starters(counts, abbreviations)))
    assert got == [(4, 0, "in the U.S."), (4, 1, "index"), (5, 0, "in the U.S."), (5, 1, "It rose"),   # a newline, a starter
                   (6, 0, "a!"), (6, 1, "b?"), (6, 2, "c"), (7, 0, "(see vs.) other")]
    assert token_counts(frame(spark, texts).limit(0)).count() == 0
    assert learned_abbreviations(token_counts(frame(spark, texts).limit(0))).count() == 0


def test_texts_are_counted_once(spark):
    learn = plan(token_counts(frame(spark)))
    below = learn.rsplit("partial_count", 1)[1].split("Generate")[0]   # between the tokens and their first count
    assert "RLIKE" not in below and "regexp_replace" not in below
    for name, scans in (("q_learned_abbreviations", 0), ("q_learned_sentences", 1)):   # the split reads them, the counts are staged
        assert plan(queries()[name](spark, SF_SMALL)).count("FileScan parquet [doc_id") == scans, name


def test_counts_of_awkward_lines(spark):
    texts = ["a.\tb.\r\n.. c. \n\n (D.) e.\x0b f.", "\n", " g.", None]
    assert rows(token_counts(frame(spark, texts))) == [
        ("a", True, "b", 1), ("b", True, "", 1), ("c", True, "", 1), ("d", True, "e", 1), ("e", True, "f", 1),
        ("f", True, "", 1), ("g", True, "", 1)]
