"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a
bitmask with one bit a language, an n-gram sets its languages' bits in K slots,
and the AND of its K slots gives every language that has it at once. For a
text, the n-grams found are counted for each language; each count is corrected
by the false-positive rate of that language's bit plane, and the largest
corrected share decides.

Fitting reads a bounded sample (``FIT_DOCS`` documents of each language, chosen
by hash of the id); predictions read every whole text. N-grams are four
characters of the lower-cased text, runs of other characters than letters
counting as one space.

Defined cases: a text that is null or has no letter gives ``und`` with score 0;
ties go to the language that sorts first; rows without language are not learned
from; without any labelled row everything is ``und``; a null id is not held out.
Masks are as wide as the languages ask for (planes of 64 bits); of more than
``MAX_LANGUAGES`` labels the most frequent are learned (ties: those that sort first).
An n-gram belongs to a language if at least ``MIN_RATE`` of the language's fitted
documents hold it (the noise floor); its bit is then set, whatever other languages do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import code_points, map_arrow, mix, text_slices

N = 4                 # characters of an n-gram
FIT_DOCS = 5000       # documents of each language that fitting reads at most (about)
SLOT_BITS = 20        # 2^20 slots
K = 3                 # slots of an n-gram
MIN_RATE = 0.002      # share of a language's documents that must hold an n-gram
MAX_LANGUAGES = 1024  # 16 planes: 128 MB
MIN_SHARE = 0.2       # below this share of known n-grams the text is in no learned language
UNDETERMINED = "und"

_U = np.uint64
_ALPHA: np.ndarray | None = None


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def ngrams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``texts`` and each text's range of them (offsets).

    A text without letters has none; others are padded with spaces on both sides.
    """
    codes, starts = code_points([f"  {t.lower()} " for t in texts])
    letter = _alpha()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]              # the one space after a run of letters
    keep[starts[:-1]] = True             # and the two before the text
    keep[starts[:-1] + 1] = True
    idx = np.flatnonzero(keep)
    seq = np.where(letter[idx], codes[idx], 0x20).astype(_U)
    h = np.zeros(max(0, len(seq) - n + 1), _U)
    for k in range(n):
        h = h * _U(0x100000001B3) + seq[k:k + len(h)]
    off = np.searchsorted(idx, starts)
    has = np.add.reduceat(letter, starts[:-1]) > 0
    count = np.where(has, np.maximum(np.diff(off) - n + 1, 0), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(off[:-1] - ends[:-1], count)
    return mix(h[at]), ends


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    m = _U((1 << bits) - 1)
    return [(h >> _U(k * bits)) & m for k in range(K)]


@dataclass
class LanguageFilters:
    """The fitted filter: language names, bitmasks (a row for each plane of 64 languages, a column for each
    slot), false-positive rate of each language's bits."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected share of them in each language)."""
        h, off = ngrams(texts)
        bits = int(self.slots.shape[1]).bit_length() - 1
        mask = None
        for s in _slots(h, bits):
            mask = self.slots[:, s] if mask is None else mask & self.slots[:, s]
        n = np.diff(off)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        for k, f in enumerate(self.false_positive):
            one = ((mask[k // 64] >> mask.dtype.type(k % 64)) & mask.dtype.type(1)).astype(np.int64)
            if len(some):
                found = np.add.reduceat(one, off[:-1][some]) / n[some]
                out[some, k] = np.clip((found - f) / max(1 - f, 1e-9), 0, 1)
        return n, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each n-gram, by language, for each chunk of texts."""
    for b in batches:
        langs = b.column("lang").to_pylist()
        for lo, hi, texts in text_slices(b, "text"):
            h, off = ngrams(texts)
            doc = np.repeat(np.arange(hi - lo), np.diff(off))
            names, code = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
            for k, name in enumerate(names.tolist()):
                mine = code[doc] == k
                order = np.lexsort((doc[mine], h[mine]))
                g, d = h[mine][order], doc[mine][order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                gram, n = np.unique(g[new], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        fit_docs: int = FIT_DOCS, slot_bits: int = SLOT_BITS) -> LanguageFilters:
    """Learn the filters from the labelled rows of ``docs`` (a bounded sample of them)."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageFilters([], np.zeros((1, 1 << slot_bits), np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, fit_docs / sizes[n]))])
    # uniform in [0, 1), the same for every run; a null id is spread by its text
    spread = F.pmod(F.xxhash64(F.lit("fit"), "id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(spread < F.element_at(share, F.col("lang")))
    used = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    per_doc = F.create_map(*[F.lit(x) for n in names for x in (n, 1.0 / max(1, used.get(n, 0)))])
    number = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    counted = map_arrow(sample.select("text", "lang"), _count, "lang string, gram long, n long")
    rates = (counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
             .select("gram", (F.col("n") * F.element_at(per_doc, F.col("lang"))).alias("rate"),
                     F.element_at(number, F.col("lang")).alias("number")).where(F.col("rate") >= MIN_RATE)
             .groupBy("gram", F.expr("number div 64").alias("plane"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(number % 64 as int))")).alias("mask")))
    mask = (1 << slot_bits) - 1
    slot = F.explode(F.array(*[F.expr(f"shiftrightunsigned(gram, {k * slot_bits}) & {mask}L") for k in range(K)]))
    rows = (rates.select(slot.alias("slot"), "plane", "mask").groupBy("slot", "plane")
            .agg(F.bit_or("mask").alias("mask")).toArrow())   # at most 2^slot_bits rows of 24 bytes a plane
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(len(names), 64))
    slots = np.zeros((-(-len(names) // 64), 1 << slot_bits), kind)
    slots[rows["plane"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64).astype(kind)
    fill = np.array([((slots[k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(names))])
    return LanguageFilters(names, slots, fill ** K)


def _predict(model_broadcast, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageFilters = model_broadcast.value
        for b in batches:
            for lo, hi, texts in text_slices(b, text_col):
                n, shares = model.shares(texts)
                if model.languages:
                    best = shares.argmax(axis=1)
                    score = shares[np.arange(hi - lo), best]
                    name = [model.languages[k] if m else UNDETERMINED for k, m in zip(best.tolist(), n.tolist())]
                else:
                    score, name = np.zeros(hi - lo), [UNDETERMINED] * (hi - lo)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(name, pa.string()), pa.array(score), pa.array(n.astype(np.int64))],
                    [*b.schema.names, "__lang_pred", "__score", "__n_grams"])
    return run


def identify(docs: DataFrame, model: LanguageFilters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__lang_pred``, ``__score`` (0 to 1) and ``__n_grams`` for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, _predict(shared, text_col),
                     f"{fields}, __lang_pred string, __score double, __n_grams long")


def keep_known(docs: DataFrame, model: LanguageFilters, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of the learned languages, with the columns of ``docs``."""
    return identify(docs, model, text_col).where(
        (F.col("__lang_pred") != UNDETERMINED) & (F.col("__score") >= MIN_SHARE)).select(*docs.columns)
