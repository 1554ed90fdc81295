"""Exact round trip of the ids, and the limits of the sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moodcast.llm import packing as K
from moodcast.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library_on_awkward_texts(reference):
    mine = K.word_tokenizer(PATH)
    random.seed(3)
    parts = ["a", "B", "é", "1", "٣", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'ve", "'d", "'x", ".", "!", " ", "　",
             "中", "\U0001F600", "\0", "́", "Ⅷ", "½", "\x1c", "\x85", "<|endoftext|>", "_", "ſ", "ǅ", " '", "don't", " I'm"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 16))) for _ in range(1500)]
    for lo in range(0, len(texts), 50):
        ids, off = mine.encode(texts[lo:lo + 50])
        for i, t in enumerate(texts[lo:lo + 50]):
            assert ids[off[i]:off[i + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(K, "CACHE_ENTRIES", 20)
    mine = K.WordTokenizer(PATH)
    texts = [f"word{i} and {i * 7} others, it's {chr(97 + i % 26)}" for i in range(60)]
    for lo in range(0, 60, 5):
        ids, off = mine.encode(texts[lo:lo + 5])
        for i, t in enumerate(texts[lo:lo + 5]):
            assert ids[off[i]:off[i + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_file(spark):
    unmodified = Tokenizer.from_file(PATH)
    assert unmodified.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "", "plain words", "<|endoftext|>", "<|endoftext|><|endoftext|> it's\n <|endoftext", "x" * 50 + "<|endoftext|>"]
    ids, off = K.word_tokenizer(PATH).encode_as_file(texts)
    want = [unmodified.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[off[i]:off[i + 1]].tolist() for i in range(len(texts))] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in K.pack_documents(df, PATH).collect()}
    assert got == {i: w + [1] for i, w in enumerate(want)}


def check(rows, texts, reference):
    """Every id in one piece, sequences gapless and within the limits; returns the padded share."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(pieces) <= K.MAX_SEGMENTS
        total += at
    return 1 - total / (2048 * len(by_seq))


def test_query_round_trip(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert check(Q.QUERIES["op5_vector_packing"](spark, SF_SMALL).collect(), texts, reference) < 0.02


def test_edge_rows(spark, reference):
    from pyspark.sql import functions as F

    docs = edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    rows = K.pack_documents(docs, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, {r[0]: r[1] for r in edge_rows() if r[0] is not None}, reference)
    assert K.pack_documents(edge_docs(spark), PATH).where("doc_id is null").count() == 3
    assert K.pack_documents(empty_docs(spark), PATH).count() == 0


def test_simultaneous_limits():
    rng = random.Random(5)
    limits = K.Limits(tokens=100, segments=4, loss=30, min_cut=5)
    packer, out, loss = K.Packer(limits, pool=16), [], {}
    for i in range(200):
        n = rng.randint(1, 260)
        a = rng.randint(0, n)
        loss[i] = (n, a, rng.randint(a, n))
        out += packer.add(i, *loss[i])
    out += packer.finish()
    seqs, docs = {}, {}
    for example, at, n, seq, off in out:
        seqs.setdefault(seq, []).append((off, n, example, at))
        docs.setdefault(example, []).append((at, n))
    for i, pieces in docs.items():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == loss[i][0]
    for pieces in seqs.values():
        at = 0
        for off, n, _, _ in sorted(pieces):
            assert off == at
            at += n
        assert at <= 100 and len(pieces) <= 4
        assert sum(max(0, min(a + n, loss[e][2]) - max(a, loss[e][1])) for _, n, e, a in pieces) <= 30


def test_loss_columns_bind(spark):
    """Half of the examples bear loss on their second half only: the loss limit, not the tokens, closes sequences."""
    rows = [(i, " ".join(["word"] * (40 + i % 17)), (20 if i % 2 else None), None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a long, b long").coalesce(1)
    limits = K.Limits(tokens=256, segments=16, loss=100, min_cut=4)
    out = K.pack_documents(docs, PATH, limits=limits, loss_from_col="a", loss_to_col="b").collect()
    total, loss, pieces = {}, {}, {}
    for r in out:
        first = rows[r["doc_id"]][2] or 0
        s = r["sequence_id"]
        total[s] = total.get(s, 0) + r["length"]
        loss[s] = loss.get(s, 0) + max(0, min(r["start"] + r["length"], r["doc_tokens"] - 1) - max(r["start"], first))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert max(loss.values()) <= 100 and max(total.values()) <= 256
    bound = [s for s in loss if loss[s] > 100 - 4]
    assert len(bound) > 0.9 * len(loss) and np.mean([total[s] for s in bound]) < 220
    for parts in pieces.values():
        at = 0
        for start, n, whole in sorted(parts):
            assert start == at
            at += n
        assert at == whole


def test_default_loss_limit_binds(spark):
    docs = spark.createDataFrame([(1, " word" * 5000)], "doc_id long, text string")
    out = K.pack_documents(docs, PATH).collect()
    assert max(r["length"] for r in out) == K.MAX_LOSS < K.MAX_TOKENS
