"""Alignment against a version that compares all tokens of a text."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from moodcast.llm import alignment as A
from moodcast.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def bytes_of_letters():
    """The published table of byte-level vocabularies, by its own loop."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


LETTERS = bytes_of_letters()


def tokens(tokenizers, text):
    """(id, bytes) of both sides, or nothing."""
    if not text:
        return [], []
    a, b = tokenizers
    one = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">")
                    else p.encode().replace("▁".encode(), b" ")))
    want = (" " + text).encode()
    if b"".join(t for _, t in one) != want or b"".join(t for _, t in two) != want:
        return [], []
    return one, two


def direct(tokenizers, rows):
    per_doc, count = [], collections.Counter()
    for doc, text in rows:
        sides, at = tokens(tokenizers, text), []
        for side in sides:
            end, out = 0, []
            for i, t in side:
                end += len(t)
                out.append((end, i))
            at.append(out)
        links = [(i, j) for e, i in at[0] for f, j in at[1] if e == f] if len(at[0]) * len(at[1]) < 10**6 else [
            (i, dict(at[1])[e]) for e, i in at[0] if e in {f for f, _ in at[1]}]
        ends = sorted({e for e, _ in at[0]} & {e for e, _ in at[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for f, i in side if lo < f <= e) for side in at))
            lo = e
        per_doc.append((doc, len(at[0]), len(at[1]), len(groups), links,
                        hashlib.sha256(";".join(groups).encode()).hexdigest() if at[0] else ""))
        count.update(links)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(d, a, b, g, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sha)
            for d, a, b, g, links, sha in per_doc], count


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_query_equals_direct_version(spark, tokenizers):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    docs = [(i, t[:2500]) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = A.align(df, PATH_A, PATH_B)[0]
    assert ordered(map(tuple, got.collect())) == ordered(direct(tokenizers, docs)[0])
    rows = Q.QUERIES["op13_token_alignment"](spark, SF_SMALL)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows.count() == len(docs)


def test_awkward_texts(spark, tokenizers):
    random.seed(7)
    parts = ["a", "B", "é", "1", " ", "  ", "\n", "\t", "'s", "'ll", "▁", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "中", "文",
             "\U0001F600", "\0", "́", " the", " and", "ing", "tion", "\x85", "\xa0", "ſ", "٣", "http://x.y/z?a=b&c"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(400)] + [None, "", " ", "  x", "x"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 3
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, n_a int, pairs string")
    want, count = direct(tokenizers, rows)
    for common in (1 << 16, 10, 0):   # all, some or none of the pairs are looked up
        got, pairs = A.align(df, PATH_A, PATH_B, common=common)
        assert ordered(map(tuple, got.collect())) == ordered(want)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(count)
    assert sum(w[1] == 0 for w in want) < len(want) / 2


def test_edge_rows(spark, tokenizers):
    rows = [r[:2] for r in edge_rows() if len(r[1] or "") < 50_000]
    df = edge_docs(spark).where("text is null or length(text) < 50000")
    assert ordered(map(tuple, A.align(df, PATH_A, PATH_B)[0].collect())) == ordered(direct(tokenizers, rows)[0])
    assert A.align(edge_docs(spark), PATH_A, PATH_B)[0].count() == len(edge_rows())
    assert A.align(empty_docs(spark), PATH_A, PATH_B)[0].count() == 0


def test_overlaps_are_those_of_all_pairs(tokenizers):
    pair = A.TokenPair(PATH_A, PATH_B)
    texts = ["Tokenisation of internationalised strings", "", "naïve café 中文", "x"]
    a, n_a, b, n_b = pair.encode(texts)
    left, right = A._side(a, n_a, pair.bytes_a), A._side(b, n_b, pair.bytes_b)
    got = {(r.a, r.b) for r in A.overlaps(left, right).itertuples()}
    want = {(x.token, y.token) for x in left.itertuples() for y in right.itertuples() if x.start < y.end and y.start < x.end}
    assert got == want and len(want) > 10
