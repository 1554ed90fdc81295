"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at 8 positions of 13 words, or at 5 of 7 and of 11, and ignore
the others, so a benchmark passage is found although words were replaced: no
choice of substitutions that keeps the identity of an item of 13 to 25 words
misses all masks. The hashes of all mask positions of the benchmark join those of
the documents; around each hit the document and the item are compared word by
word along the hit's diagonal, and the best segment (match +1, substitution -2)
is the overlap. Where it fails a limit, the segment with most equal words among
those that keep both limits is. An item of fewer than 15 words needs 0.8 of its
words, others ``MIN_MATCHED``.

The join side of the documents is thinned by a Bloom filter of the benchmark's
hashes of a fixed size (2 MB whatever the benchmark's size); the join itself is
an ordinary shuffle join, so a benchmark of any size is handled whole.

Defined cases: null or empty texts match nothing, and so do items of fewer than
``MIN_ITEM`` words; repeated benchmark rows count once; repeated
document rows give one result row each pair; null ids stay null and are still
matched by text; extra columns are ignored; an empty table on either side gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import map_arrow, materialise, mix, text_slices, window_hashes, word_hashes

MASKS = ("1101010011011", "1110100101011", "1011011100101", "1101011", "10000001111")
FILTER_BITS = 24
MIN_ITEM = 13        # words of an item
MIN_MATCHED = 12     # words equal in the overlap
MIN_IDENTITY = 0.8   # their share of the overlap
MISMATCH = -2

_U = np.uint64
_BIT = _U((1 << FILTER_BITS) - 1)


def seed_hashes(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask, the hash at each position of ``words`` (uint64)."""
    out = []
    for k, m in enumerate(masks):
        chosen = [i for i, c in enumerate(m) if c == "1"]
        if len(words) < len(m):
            out.append(np.zeros(0, _U))
            continue
        h = window_hashes(words, chosen)[:len(words) - len(m) + 1]
        out.append(mix(h + _U(k + 1)))
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = {"id": b.column("id"), "words": [], "pos": [], "seed": []}
        for text in (t for _, _, texts in text_slices(b, "text") for t in texts):
            w, _ = word_hashes([text])
            seeds = seed_hashes(w if len(w) >= MIN_ITEM else w[:0])
            rows["words"].append(w.tobytes())
            rows["pos"].append(np.concatenate([np.arange(len(s), dtype=np.int32) for s in seeds]))
            rows["seed"].append(np.concatenate(seeds).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [rows["id"], pa.array(rows["words"], pa.binary()), pa.array(rows["pos"], pa.list_(pa.int32())),
             pa.array(rows["seed"], pa.list_(pa.int64()))], list(rows))


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    """Bloom filter of two bits a seed: at most 2^18 rows of 64 bits come to the driver."""
    bit = F.explode(F.array(F.expr(f"seed & {int(_BIT)}L"),
                            F.expr(f"shiftrightunsigned(seed, {FILTER_BITS}) & {int(_BIT)}L"))).alias("bit")
    rows = (seeds.select(bit).groupBy(F.expr("bit div 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect())
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _probe(bits_broadcast):
    """Documents with a position whose seed is in the filter: their word hashes and those positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bits_broadcast.value
        known = np.unpackbits(packed, bitorder="little").view(bool)
        for b in batches:
            for lo, hi, texts in text_slices(b, "text"):
                words, off = word_hashes(texts)
                hit_pos, hit_seed = [], []
                for m, s in zip(MASKS, seed_hashes(words)):
                    at = np.flatnonzero(known[s & _BIT] & known[(s >> _U(FILTER_BITS)) & _BIT])
                    end = off[np.searchsorted(off, at, "right")]
                    at = at[at + len(m) <= end]   # a mask does not cross documents
                    hit_pos.append(at)
                    hit_seed.append(s[at])
                pos, seed = np.concatenate(hit_pos), np.concatenate(hit_seed)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, seed = pos[order], seed[order]
                doc = np.searchsorted(off, pos, "right") - 1
                which, first = np.unique(doc, return_index=True)
                ends = [*first[1:].tolist(), len(pos)]
                out = ([], [], [])
                for d, a, z in zip(which.tolist(), first.tolist(), ends):
                    out[0].append(words[off[d]:off[d + 1]].tobytes())
                    out[1].append((pos[a:z] - off[d]).astype(np.int32))
                    out[2].append(seed[a:z].view(np.int64))
                take = pa.array(which + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("xh").take(take), pa.array(out[0], pa.binary()),
                     pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64()))],
                    ["id", "xh", "words", "pos", "seed"])
    return run


def best_segment(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the segment of ``same`` with the highest score (the first such)."""
    score = np.where(same, 1, MISMATCH)
    total = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[:end + 1])), end


def _least(share: float) -> tuple[int, int]:
    """``share`` as a whole fraction, for exact comparisons."""
    f = Fraction(str(share))
    return f.numerator, f.denominator


def widest_segment(same: np.ndarray, identity: float = MIN_IDENTITY) -> tuple[int, int]:
    """Start and end of the segment with most equal words among those with a share of at least ``identity``
    (of these the shortest, then the first)."""
    num, den = _least(identity)
    total = np.concatenate([[0], np.cumsum(np.where(same, den - num, -num))])
    # the longest such segment to each end starts at the first total that is not above the end's
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    equal = np.concatenate([[0], np.cumsum(same)])
    matched = equal - equal[start]
    ends = np.flatnonzero(matched == matched.max())
    end = int(ends[np.argmin(ends - start[ends])])
    a, hits = int(start[end]), np.flatnonzero(same[start[end]:end])
    return (a + int(hits[0]), a + int(hits[-1]) + 1) if len(hits) else (a, a)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, kept = [], []
        num, den = _least(MIN_IDENTITY)
        for k, (d, i, need) in enumerate(zip(b.column("d").to_pylist(), b.column("i").to_pylist(), b.column("need").to_pylist())):
            same = np.frombuffer(d, np.int64) == np.frombuffer(i, np.int64)
            if same.sum() < need:   # no segment can do
                continue
            a, z = best_segment(same)
            if same[a:z].sum() < need or den * same[a:z].sum() < num * (z - a):
                a, z = widest_segment(same)
            out.append((a, z - a, int(same[a:z].sum())))
            kept.append(k)
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [b.column(c).take(pa.array(kept, pa.int64())) for c in ("did", "iid", "d_from", "i_from", "need")]
            + [pa.array(c, pa.int32()) for c in cols],
            ["did", "iid", "d_from", "i_from", "need", "at", "n_words", "n_matched"])


def _needed(item_words: Column) -> Column:
    """Equal words that an overlap with an item of so many words needs."""
    num, den = _least(MIN_IDENTITY)
    return F.least(F.lit(MIN_MATCHED), F.ceil(item_words * num / den).cast("int"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share a passage.

    Columns: ``id_col``, ``item_col``, ``text_xxhash64`` (of the document's
    text), ``doc_start`` and ``item_start`` (word positions of the longest
    overlap), ``n_words``, ``n_matched``, ``identity``, ``item_words``.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).distinct()
    item_type = bench.schema["id"].dataType.simpleString()
    items = materialise(map_arrow(bench, _items, f"id {item_type}, words binary, pos array<int>, seed array<long>")
                        .withColumn("iid", F.monotonically_increasing_id()), "items")
    seeds = items.select("iid", F.explode(F.arrays_zip("pos", "seed")).alias("s")).select(
        "iid", F.col("s.pos").alias("ipos"), F.col("s.seed").alias("seed"))
    bits = spark.sparkContext.broadcast(np.packbits(_filter_bits(seeds), bitorder="little"))

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("xh"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    probed = materialise(
        map_arrow(src, _probe(bits), f"id {id_type}, xh long, words binary, pos array<int>, seed array<long>")
        .withColumn("did", F.monotonically_increasing_id()), "probed")
    hits = probed.select("did", F.explode(F.arrays_zip("pos", "seed")).alias("s")).select(
        "did", F.col("s.pos").alias("dpos"), F.col("s.seed").alias("seed"))
    diagonals = (hits.join(seeds, "seed")
                 .groupBy("did", "iid", (F.col("dpos") - F.col("ipos")).alias("diag")).agg(F.count("*").alias("hits")))
    # the words of both sides along the diagonal
    pair = (diagonals.join(probed.select("did", F.col("words").alias("dw")), "did")
            .join(items.select("iid", F.col("words").alias("iw")), "iid")
            .withColumn("d_from", F.greatest("diag", F.lit(0)))
            .withColumn("i_from", F.greatest(-F.col("diag"), F.lit(0)))
            .withColumn("n", F.least((F.length("dw") / 8).cast("int") - F.col("d_from"),
                                     (F.length("iw") / 8).cast("int") - F.col("i_from")))
            .select("did", "iid", "d_from", "i_from", _needed(F.length("iw") / 8).alias("need"),
                    F.expr("substring(dw, d_from * 8 + 1, n * 8)").alias("d"),
                    F.expr("substring(iw, i_from * 8 + 1, n * 8)").alias("i")))
    found = map_arrow(pair, _verify, "did long, iid long, d_from int, i_from int, need int, at int, n_words int, n_matched int")
    num, den = _least(MIN_IDENTITY)
    best = (found.where((F.col("n_matched") >= F.col("need")) & (F.col("n_matched") * den >= F.col("n_words") * num))
            .groupBy("did", "iid").agg(F.max(F.struct(
                "n_matched", (-F.col("n_words")).alias("less"), (-(F.col("d_from") + F.col("at"))).alias("d"),
                (-(F.col("i_from") + F.col("at"))).alias("i"))).alias("b")))
    return (best.join(probed.select("did", F.col("id").alias("__doc"), "xh"), "did")
            .join(items.select("iid", F.col("id").alias("__item"), (F.length("words") / 8).cast("int").alias("item_words")), "iid")
            .select(F.col("__doc").alias(id_col), F.col("__item").alias(item_col), F.col("xh").alias("text_xxhash64"),
                    (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"),
                    (-F.col("b.less")).alias("n_words"), F.col("b.n_matched").alias("n_matched"),
                    F.round(-F.col("b.n_matched") / F.col("b.less"), 6).alias("identity"), "item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark, with all their columns."""
    bad = materialise(overlaps(docs, benchmark, id_col, text_col).select(
        F.col(id_col).alias("__id"), F.col("text_xxhash64").alias("__xh")).distinct(), "contaminated")
    hashed = docs.withColumn("__xh0", F.xxhash64(text_col))
    return hashed.join(bad, hashed[id_col].eqNullSafe(bad["__id"]) & (hashed["__xh0"] == bad["__xh"]),
                       "left_anti").select(*docs.columns)
