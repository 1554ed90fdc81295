"""Held-out accuracy, filter properties and awkward rows."""

import zlib

import numpy as np

from moodcast.llm import language_id as L
from moodcast.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, empty_docs


def test_held_out_accuracy_and_columns(spark):
    rows = Q.QUERIES["op4_language_id"](spark, SF_SMALL).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_ngrams_follow_the_definition():
    def direct(text):
        s = "  " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        out = "  "
        for c in s[2:]:
            if c != " " or not out.endswith(" "):
                out += c
        return [out[i:i + 4] for i in range(len(out) - 3)] if any(c.isalpha() for c in text.lower()) else []

    texts = ["", "a", "Hello,  World!", "123", "..ab", "é\0ü", "a-b c1d"]
    h, off = L.ngrams(texts)
    grams = [direct(t) for t in texts]
    assert np.diff(off).tolist() == [len(g) for g in grams]
    by_gram = {}
    for g, x in zip([g for gs in grams for g in gs], h.tolist()):
        assert by_gram.setdefault(g, x) == x
    assert len(set(by_gram.values())) == len(by_gram)


def test_filter_has_no_false_negatives_and_corrects_false_positives(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("uno dos tres cuatro", "es"), ("one two three four", "en")] * 3)], "doc_id long, text string, lang string")
    model = L.fit(docs, slot_bits=10)
    n, shares = model.shares(["one two three four", "uno dos tres cuatro", ""])
    assert model.languages == ["en", "es"] and n[2] == 0
    assert shares[0, 0] == 1.0 and shares[1, 1] == 1.0
    rng = np.random.default_rng(0)
    noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4000))]
    assert model.shares(noise)[1].max() < 0.02   # about 0 once the false positives are taken off


def test_bounded_sample_fits_within_the_bound(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = L.fit(docs, fit_docs=10)
    found = L.identify(docs.select("text", "lang"), model).collect()
    assert np.mean([r["__lang_pred"] == r["lang"] for r in found]) > 0.9


def grams_of(text):
    """The n-grams of a text, one character at a time."""
    if not any(c.isalpha() for c in text.lower()):
        return []
    out = "  "
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or out[-1] != " " or len(out) < 2:
            out += c
    return [out[i:i + 4] for i in range(len(out) - 3)]


def test_decision_equals_exact_sets(spark):
    """The decision of a plain version: sets of n-grams without hashing, every language of each n-gram."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang is not null and text is not null")
    rows = docs.select("doc_id", "text", "lang").collect()
    held, sizes = {}, {}
    for r in rows:
        sizes[r["lang"]] = sizes.get(r["lang"], 0) + 1
        for g in set(grams_of(r["text"])):
            held.setdefault(r["lang"], {}).setdefault(g, 0)
            held[r["lang"]][g] += 1
    names = sorted(sizes)
    sets = {n: {g for g, c in held[n].items() if c / sizes[n] >= L.MIN_RATE} for n in names}
    found = {r["doc_id"]: r for r in L.identify(docs, L.fit(docs)).collect()}
    assert len(found) == len(rows) > 50
    for r in rows:
        grams = grams_of(r["text"])
        share = [sum(g in sets[n] for g in grams) / max(1, len(grams)) for n in names]
        best = found[r["doc_id"]]
        assert best["__n_grams"] == len(grams)
        assert abs(best["__score"] - max(share)) < 0.05
        if sorted(share)[-1] - sorted(share)[-2] > 0.05:
            assert best["__lang_pred"] == names[int(np.argmax(share))]


def test_more_labels_than_a_mask_has_bits(spark):
    rows = [(k * 3 + i, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}{x}" for x in ("ab", "cd", "ef")), f"l{k:03d}")
            for k in range(150) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert len(model.languages) == 150 and model.slots.shape == (3, 1 << L.SLOT_BITS)
    assert all(r["__lang_pred"] == r["lang"] for r in L.identify(docs, model).collect())


def test_edge_rows(spark):
    docs = edge_docs(spark)
    model = L.fit(docs)
    rows = L.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in (r["text"] or "").lower())
        assert (r["__lang_pred"] == "und") == (not letters)
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 10}


def test_empty_and_unlabelled(spark):
    none = L.fit(empty_docs(spark))
    assert none.languages == []
    assert {r["__lang_pred"] for r in L.identify(edge_docs(spark), none).collect()} == {"und"}
    assert L.identify(empty_docs(spark), none).count() == 0
