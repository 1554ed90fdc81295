"""N-gram Jaccard self-join with Bayesian candidate pruning.

Every document becomes the set of its five-word shingles (hashed to 64 bits;
shorter documents: one shingle of all their words). Documents with equal sets
form a class of copies and only one of them goes on. MinHash bands propose
candidates; inside a bucket, MinHash values are compared a few at a time and a
pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior) falls below the tolerance. The pairs that
survive join their documents into groups, and inside a group every pair is
verified exactly on the whole shingle sets.

Pairs are never made into rows: a task compares two blocks of bounded size and
returns counts of links and a spanning forest, so a group of n near copies
moves n x (n / block) rows and returns n rows for each block pair.

Defined cases: a text that is null or has no word has no shingle, joins
nothing and is its own class; repeated rows are copies of each other; a null
id stays null; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import (by_group, chunks, map_arrow, materialise, mix, text_slices,
                                 window_hashes, word_hashes)
from moodcast.llm.components import connected_components

SHINGLE_WORDS = 5
NUM, DEN = 4, 5          # threshold 0.8 as a fraction: compared without rounding
BANDS, BAND_ROWS = 32, 4  # a pair at 0.8 shares a band with probability 1 - 5e-8
STEP = 16                # MinHash values compared at a time
TOLERANCE = 1e-6         # posterior below which a pair is dropped
BUCKET_BLOCK = 1024      # signatures of a bucket that one task holds, twice
TEXT_BLOCK = 128         # texts of a group that one task holds, twice
SLAB = 4096              # shingles counted at a time in the exact check

_U = np.uint64
_A = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = mix(_A)


def min_matches(threshold: float, tolerance: float, total: int, step: int) -> list[tuple[int, int]]:
    """(values compared, fewest matches a pair needs to stay) after each step.

    With m of n values equal and a uniform prior, the posterior of the
    similarity is Beta(m+1, n-m+1), and P(similarity >= t) is the probability
    that a binomial of n+1 trials at t has at most m successes.
    """
    out = []
    for n in range(step, total + 1, step):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


STAY = min_matches(NUM / DEN, TOLERANCE, BANDS * BAND_ROWS, STEP)


def shingle_sets(texts: list[str], k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in chunks(texts):
        words, off = word_hashes(texts[lo:hi])
        full = window_hashes(words, range(k))
        for a, b in zip(off[:-1], off[1:]):
            if b - a >= k:
                yield np.unique(full[a:b - k + 1])
            elif b > a:
                yield window_hashes(words[a:b], range(b - a))
            else:
                yield np.zeros(0, _U)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (one row per set; sets are not empty)."""
    flat = np.concatenate(sets)
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    out = np.empty((len(sets), len(_A)), _U)
    for k in range(len(_A)):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], at)
    return out


_SIG_SCHEMA = "id {id}, xh long, h1 long, h2 long, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the shingle set, shortened MinHash values and band keys of each document."""
    mult = mix(np.arange(11, 11 + BAND_ROWS, dtype=_U)) | _U(1)
    band = np.arange(BANDS, dtype=_U) * _U(0x51ED27)
    for batch in batches:
        for lo, hi, texts in text_slices(batch, "text"):
            sets = list(shingle_sets(texts))
            some = [i for i, s in enumerate(sets) if len(s)]
            h1, h2 = [None] * len(sets), [None] * len(sets)
            sig, bands = [None] * len(sets), [None] * len(sets)
            if some:
                values = _signatures([sets[i] for i in some])
                short = (mix(values) & _U(0xFFFF)).astype(np.uint16)
                rows = values.reshape(len(some), BANDS, BAND_ROWS)
                keys = mix((rows * mult).sum(axis=2, dtype=_U) + band).view(np.int64)
                for r, i in enumerate(some):
                    d = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    h1[i], h2[i] = np.frombuffer(d, np.int64).tolist()
                    sig[i], bands[i] = short[r].tobytes(), keys[r]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), batch.column("xh").slice(lo, hi - lo),
                 pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["id", "xh", "h1", "h2", "sig", "bands"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of n nodes under the edges a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        lo = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], lo)
        np.minimum.at(new, root[b], lo)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def _sides(t: pa.Table) -> tuple[np.ndarray, bool]:
    """Rows ordered by block, the size of the first block, and whether both blocks are one."""
    block = t.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    one = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
    return order, int((block == t.column("bi")[0].as_py()).sum()), one


def _pairs(mask: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.triu(mask, 1) if one else mask)


def _prune(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the bucket's pairs that survive the pruning."""
    order, split, one = _sides(t)
    rid = t.column("rid").to_numpy()[order]
    sig = np.stack([np.frombuffer(s, np.uint16) for s in t.column("sig").to_pylist()])[order]
    left, right = (sig, sig) if one else (sig[:split], sig[split:])
    base = 0 if one else split
    if not len(left) or not len(right):
        return
    alive_a = alive_b = got = None
    for n, need in STAY:
        cols = slice(n - STEP, n)
        if alive_a is None:
            same = np.zeros((len(left), len(right)), np.int16)
            for c in range(n - STEP, n):
                same += left[:, c, None] == right[None, :, c]
            alive_a, alive_b = _pairs(same >= need, one)
            got = same[alive_a, alive_b]
        else:
            got = got + (left[alive_a, cols] == right[alive_b, cols]).sum(axis=1)
            stay = got >= need
            alive_a, alive_b, got = alive_a[stay], alive_b[stay], got[stay]
        if not len(alive_a):
            return
    root = _forest(len(sig), alive_a, alive_b + base)
    child = np.flatnonzero(root != np.arange(len(root)))
    if len(child):
        yield pa.RecordBatch.from_arrays([pa.array(rid[child]), pa.array(rid[root[child]])], ["u", "v"])


def _overlaps(sets: list[np.ndarray], split: int, one: bool) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with the others (one: of all with all)."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[code] > 1      # a shingle of one set is in no intersection
    doc, code = doc[common], code[common]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    left, right = (len(sets), slice(None)) if one else (split, slice(split, None))
    width = len(sets) if one else len(sets) - split
    out = np.zeros((left, width))
    top = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, top, SLAB):
        a, b = np.searchsorted(code, (lo, lo + SLAB))
        m = np.zeros((len(sets), SLAB), np.float32)
        m[doc[a:b], code[a:b] - lo] = 1
        out += m[:left] @ m[right].T
    return np.rint(out).astype(np.int64)


def _verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Exact links between the two blocks: counts for each document, and a spanning forest."""
    order, split, one = _sides(t)
    rid = t.column("rid").to_numpy()[order]
    members = t.column("members").to_numpy()[order]
    texts = t.column("text").to_pylist()
    sets = list(shingle_sets(["" if texts[i] is None else texts[i] for i in order]))
    size = np.array([len(s) for s in sets])
    if not one and split in (0, len(sets)):
        return
    inter = _overlaps(sets, split, one)
    a_size, b_size = (size, size) if one else (size[:split], size[split:])
    # inter / union >= NUM / DEN, in integers
    link = (NUM + DEN) * inter >= NUM * (a_size[:, None] + b_size[None, :])
    if one:
        np.fill_diagonal(link, False)
        docs, classes = link @ members, link.sum(axis=1)
    else:
        docs = np.concatenate([link @ members[split:], link.T @ members[:split]])
        classes = np.concatenate([link.sum(axis=1), link.sum(axis=0)])
    a, b = _pairs(link, one)
    root = _forest(len(sets), a, b + (0 if one else split))
    some = np.flatnonzero(classes)
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid[some]), pa.array(rid[root[some]]), pa.array(docs[some].astype(np.int64)),
             pa.array(classes[some].astype(np.int64))], ["rid", "root", "links", "class_links"])


def _block_pairs(df: DataFrame, size: Column, block: int) -> DataFrame:
    """Each row goes to every pair of blocks its own block is in: columns bi <= bj, block."""
    n = F.ceil(size / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("rid"), n).cast("int")
    return (df.withColumn("block", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
            .drop("other"))


def _null_safe(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["xh"] == b["xh"])


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its class of similar documents and its links.

    Columns: ``id_col``; ``class_id`` (smallest id of the connected component of
    links; null if all ids there are null); ``n_links`` (other documents with Jaccard similarity
    of at least 0.8, copies included); ``n_class_links`` (other shingle sets
    among them); ``n_copies`` (documents with the same shingle set, itself
    included); ``keep`` (true for one row of each class: the smallest id, ties
    by scan order); ``text_xxhash64``.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("xh"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    signed = materialise(
        map_arrow(src, _sign, _SIG_SCHEMA.format(id=id_type))
        .withColumn("rid", F.monotonically_increasing_id()), "signed")

    copies = materialise(signed.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("rid").alias("rep"), F.count("*").alias("members")), "copies")
    reps = signed.select("rid", "sig", "bands").join(
        copies.select(F.col("rep").alias("rid"), "members"), "rid")
    bands = reps.select("rid", F.explode("bands").alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    cand = bands.join(full, "bucket").join(signed.select("rid", "sig"), "rid")
    blocks = _block_pairs(cand, F.col("size"), BUCKET_BLOCK).drop("size")
    edges = by_group(blocks, ["bucket", "bi", "bj"], _prune, "u long, v long").distinct()

    groups = materialise(connected_components(edges), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = (groups.join(sizes, "root").withColumnRenamed("node", "rid")
               .join(copies.select(F.col("rep").alias("rid"), "members"), "rid")
               .join(signed.select("rid", "id", "xh"), "rid"))
    # a repeated row (same id, same text) comes back more than once; one is enough
    texts = members.join(src, _null_safe(members, src)).select(
        "rid", "root", "size", "members", src["text"]).dropDuplicates(["rid"])
    pairs = _block_pairs(texts, F.col("size"), TEXT_BLOCK).drop("size")
    links = materialise(by_group(pairs, ["root", "bi", "bj"], _verify,
                                 "rid long, root long, links long, class_links long"), "links")
    comps = connected_components(links.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    per_class = (copies.join(counts.withColumnRenamed("rid", "rep"), "rep", "left")
                 .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("h1", "h2", "members", F.coalesce("links", F.lit(0)).alias("links"),
                         F.coalesce("class_links", F.lit(0)).alias("class_links"),
                         F.coalesce("root", "rep").alias("comp")))
    rows = materialise(signed.select("id", "xh", "rid", "h1", "h2").join(per_class, ["h1", "h2"], "left")
                       .withColumn("comp", F.coalesce("comp", "rid")), "rows")
    first = rows.groupBy("comp").agg(F.min("id").alias("class_id"),
                                     F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first"))
    return rows.join(first, "comp").select(
        F.col("id").alias(id_col), "class_id",
        F.coalesce(F.col("links") + F.col("members") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_class_links"),
        F.coalesce("members", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("rid") == F.col("first.rid")).alias("keep"), F.col("xh").alias("text_xxhash64"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``similarity_classes`` keeps, with all their columns.

    Of rows with equal id and equal text, which are copies, any one may be the
    one kept.
    """
    names = docs.columns
    verdict = materialise(similarity_classes(docs, id_col, text_col), "verdict")
    keys = (verdict.groupBy(F.col(id_col).alias("__id"), F.col("text_xxhash64").alias("__xh"))
            .agg(F.count("*").alias("__n"), F.max("keep").alias("__keep")).where("__keep"))
    hashed = docs.withColumn("__xh0", F.xxhash64(text_col))

    def rows(k: DataFrame) -> DataFrame:
        return hashed.join(k, hashed[id_col].eqNullSafe(k["__id"]) & (hashed["__xh0"] == k["__xh"]), "left_semi")

    once = rows(keys.where("__n = 1")).select(*names)
    again = rows(keys.where("__n > 1")).groupBy(F.col(id_col).alias("__g"), "__xh0").agg(
        F.first(F.struct(*names)).alias("__row")).select("__row.*")
    return once.unionByName(again)
