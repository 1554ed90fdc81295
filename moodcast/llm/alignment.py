"""Alignment of the tokens of two tokenizers, and corpus counts of the id pairs they link.

Both tokenizers read a space and the text (tokenizer B adds the space itself). A
token covers a range of bytes of that string. In each batch of texts,
``pandas.merge_asof`` keyed by document finds for each token start the other
side's token that covers it, in both directions; the union of both gives all
pairs of tokens that overlap. Offsets where a token of both sides ends cut the
tokens into groups, and two tokens whose ranges end together are a link.

How often an id pair is linked is counted over all documents: each document's
distinct pairs are added up in the scan's tasks before the shuffle. The counts go
back to the documents in two ways: the ``COMMON`` most frequent pairs, a table of
bounded size, are looked up in the scan, so a pair that nearly every document
holds is no join key; the others, each of which is in few documents, are joined.

Defined cases: texts that are null, empty or whose tokens' bytes are not those of
the space and the text have no tokens: zeros and an empty ``groups_sha256``; null
ids stay null; repeated rows are documents of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import map_arrow, materialise, text_slices
from moodcast.llm.packing import WordTokenizer

SLICE_BYTES = 1 << 18
COMMON = 1 << 16     # pairs that are looked up in the scan (1 MB)
SPACE = "▁"          # stands for a space in tokenizer B's pieces
PAIR = 1 << 32       # a pair of ids as one number: a * PAIR + b


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow from U+0100 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(other)}


class ByteTable:
    """The bytes of every id."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)]


class TokenPair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = WordTokenizer(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_characters()
        words = self.a.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            entries[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        self.bytes_a = ByteTable(entries)
        n = self.b.get_piece_size()
        self.bytes_b = ByteTable([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, tokens of each text) of A, then of B; texts that don't come back whole have none."""
        a, off = self.a.encode([" " + t if t else "" for t in texts])
        parts = self.b.encode(texts, num_threads=1) if texts else []
        n_a, n_b = np.diff(off), np.array([len(p) if t else 0 for p, t in zip(parts, texts)], np.int64)
        b = np.fromiter(chain.from_iterable(p for p, t in zip(parts, texts) if t), np.int64, int(n_b.sum()))
        raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        want = np.frombuffer(b"".join(raw), np.uint8)
        good = _whole(self.bytes_a, a, n_a, want, size) & _whole(self.bytes_b, b, n_b, want, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        return a.astype(np.int64), np.where(good, n_a, 0), b, np.where(good, n_b, 0)


def _whole(table: ByteTable, ids: np.ndarray, count: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts' ids join to the wanted bytes."""
    length = np.zeros(len(count), np.int64)
    np.add.at(length, np.repeat(np.arange(len(count)), count), table.length[ids])
    good = (length == size) & (size > 0)
    got = table.joined(ids[np.repeat(good, count)])
    mine = want[np.repeat(good, size)]
    wrong = np.repeat(np.flatnonzero(good), size[good])[got != mine]
    good[wrong] = False
    return good


def _side(ids: np.ndarray, count: np.ndarray, table: ByteTable) -> pd.DataFrame:
    """Tokens of a batch: document, number, first byte offset and the one after the last (texts follow one another)."""
    doc = np.repeat(np.arange(len(count)), count)
    end = np.cumsum(table.length[ids])
    return pd.DataFrame({"doc": doc, "token": np.arange(len(ids)), "start": end - table.length[ids], "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of tokens that overlap: columns doc, a, b, a_end, b_end."""
    def covering(left: pd.DataFrame, right: pd.DataFrame, l: str, r: str) -> pd.DataFrame:
        """The right side's token that covers the start of each left token."""
        hit = pd.merge_asof(left, right.assign(other=right["start"]), on="start", by="doc", suffixes=("_l", "_r"))
        return pd.DataFrame({"doc": hit["doc"], l: hit["token_l"], r: hit["token_r"], f"{l}_end": hit["end_l"], f"{r}_end": hit["end_r"],
                             "same_start": hit["start"] == hit["other"]})

    # tokens that start together are found from both sides
    other = covering(b, a, "b", "a")
    both = pd.concat([covering(a, b, "a", "b"), other[~other["same_start"]]])[["doc", "a", "b", "a_end", "b_end"]]
    # from one overlap to the next, one token or both go on: the sum of their numbers orders them
    return both.iloc[np.argsort((both["a"] + both["b"]).to_numpy(), kind="stable")]


class _Labels:
    """The text of each id followed by a mark (, | ; or nothing)."""

    MARKS = (",", "|", ";", "")

    def __init__(self, n: int):
        self.n = n
        self.text = [f"{i}{m}" for m in self.MARKS for i in range(n)]

    def of(self, ids: np.ndarray, mark: np.ndarray) -> list[str]:
        text = self.text
        return [text[k] for k in (ids + mark * self.n).tolist()]


def aligned(pair: TokenPair, labels: _Labels, texts: list[str]) -> dict[str, list]:
    """For each text: counts, digest of the groups, and its distinct linked id pairs with how often each is linked."""
    ids_a, n_a, ids_b, n_b = pair.encode(texts)
    a, b = _side(ids_a, n_a, pair.bytes_a), _side(ids_b, n_b, pair.bytes_b)
    both = overlaps(a, b)
    link = both[both["a_end"] == both["b_end"]]
    docs = len(texts)
    n_links = np.bincount(link["doc"], minlength=docs)
    ends = link["a_end"].to_numpy()   # in order, each once
    doc_of = np.searchsorted(ends, np.cumsum(np.bincount(a["doc"], a["end"] - a["start"], docs)), "right")
    n_groups = np.diff(doc_of, prepend=0)
    # tokens in order of group, side and place
    token = np.concatenate([ids_a, ids_b])
    side = np.repeat([0, 1], [len(a), len(b)])
    group = np.searchsorted(ends, np.concatenate([a["end"], b["end"]]), "left")
    doc = np.concatenate([a["doc"], b["doc"]])
    order = np.argsort(group * 2 + side, kind="stable")   # places stay in order
    token, side, group, doc = token[order], side[order], group[order], doc[order]
    last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
    turn = np.append(side[1:] != side[:-1], True) if len(side) else last
    final = np.append(doc[1:] != doc[:-1], True) if len(doc) else last
    text = labels.of(token, np.where(final, 3, np.where(last, 2, np.where(turn, 1, 0))))
    cut = np.searchsorted(doc, np.arange(docs + 1)).tolist()
    digest = [hashlib.sha256("".join(text[x:y]).encode()).hexdigest() if y > x else "" for x, y in zip(cut, cut[1:])]
    # distinct pairs of each text
    wide, kinds = len(pair.bytes_b.length), len(pair.bytes_a.length) * len(pair.bytes_b.length)
    key = np.sort(link["doc"].to_numpy() * kinds + ids_a[link["a"]] * wide + ids_b[link["b"]])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, times = key[first], np.diff(first, append=len(key))
    at = np.searchsorted(key, np.arange(docs + 1) * kinds)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest,
            "pairs": _lists(key % kinds // wide * PAIR + key % wide, at), "times": _lists(times, at)}


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))


_PAIRS: dict[tuple[str, str], tuple[TokenPair, _Labels]] = {}


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path_a, path_b)
        if key not in _PAIRS:
            pair = TokenPair(path_a, path_b)
            _PAIRS[key] = pair, _Labels(max(len(pair.bytes_a.length), len(pair.bytes_b.length)))
        pair, labels = _PAIRS[key]
        for b in batches:
            for lo, hi, texts in text_slices(b, "text", SLICE_BYTES):
                found = aligned(pair, labels, texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo),
                     *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(found["groups_sha256"], pa.string()), found["pairs"], found["times"]],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        pair.a.clear()
    return run


def _look_up(shared):
    """Each document's links of common pairs added up; the other pairs are left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            flat, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            doc = np.repeat(np.arange(b.num_rows), np.diff(pairs.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            total, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(total, doc[hit], n[hit] * count[at[hit]])
            np.add.at(top, doc[hit], n[hit] * best[at[hit]])
            cut = np.searchsorted(doc[~hit], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(top), pa.array(total), _lists(flat[~hit], cut), _lists(n[~hit], cut)],
                ["row", "n_best", "count_sum", "pairs", "times"])
    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    Documents: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the largest
    of their id of B), ``count_sum`` (of the links' counts), ``groups_sha256``. Pairs: ``a``, ``b``, ``count``
    (links of both ids in all documents), ``best``.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = materialise(
        map_arrow(src, _align(path_a, path_b), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                  "groups_sha256 string, pairs array<long>, times array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "aligned")

    linked = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = linked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % PAIR)
    counts = materialise(counts, "counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))   # at most one row for each id of B
    pairs = materialise(counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")

    often = pairs.orderBy(F.desc("count"), "pair").limit(common).toArrow()   # ``common`` rows of 17 bytes
    order = np.argsort(often["pair"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(
        (often["pair"].to_numpy()[order], often["count"].to_numpy()[order],
         often["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))
    looked = map_arrow(rows.select("row", "pairs", "times"), _look_up(shared),
                       "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    looked = materialise(looked, "looked")
    rest = (looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n")).join(pairs, "pair")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("rare_best"),
                                F.sum(F.col("n") * F.col("count")).alias("rare_sum")))
    out = (rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
           .join(looked.select("row", "n_best", "count_sum"), "row").join(rest, "row", "left")
           .select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
                   (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
                   (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256"))
    return out, pairs.select(F.expr(f"pair div {PAIR}").alias("a"), (F.col("pair") % PAIR).alias("b"), "count", "best")
