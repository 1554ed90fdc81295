"""Importance resampling toward a target distribution, with exact ranks by regular sampling.

Words are runs of digits, letters and characters beyond ASCII of the text with
A-Z lowered; features are runs of 1 to ``max_words`` words. A feature's bucket is
the CRC-32 of its bytes modulo ``buckets``. Counts of the buckets over all
documents and over all target texts give one array of gains; a document's weight
is the floored mean gain of its features, and its score adds Gumbel noise drawn
from a hash of its id, so that the highest scores are a sample without
replacement.

Ranks come from parallel sorting by regular sampling: every task sorts its run of
scores and gives values at regular places, these give the splitters, the runs'
segments between splitters are exchanged, each segment is merged in one task, and
the number of rows in the segments before gives exact ranks. A run of equal
scores is split by id, so no value lands in one task.

To the driver come: ``buckets`` counts of both sides, at most ``SAMPLES`` values
of the runs and one count for each segment.

Defined cases: null and empty texts have no words and weight 0; a null id is
written as an empty one in the noise and sorts behind others of its score; rows
with the same id and score get different ranks in no given order; repeated rows
count each; without documents or target texts the counts are 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodcast.llm.common import map_arrow, materialise, shuffle_partitions

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20       # a document needs so many words to be drawn
PERCENT = 10         # share of those that are drawn
SEED = 2024
NO_ID = 1 << 62      # stands for a null id where ids are ordered
SAMPLES = 1 << 20    # regular samples of all runs together
BATCH_BYTES = 1 << 20

# A-Z are lowered, what belongs to no word becomes a space
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))


def feature_buckets(text: bytes, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, bucket of every feature) of a text in UTF-8."""
    words = text.translate(_FOLD).split()
    features = list(words)
    for n in range(2, max_words + 1):
        features += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    hashes = np.fromiter(map(zlib.crc32, features), np.uint32, len(features))
    return len(words), (hashes % np.uint32(buckets)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch.column("text").cast(pa.binary()):
        yield t.as_py() or b""


def bucket_counts(docs: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket (each task adds up its own first)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in _texts(b):
                total += np.bincount(feature_buckets(text, max_words, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = (map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())   # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the smoothed log ratio of target to source, for each bucket, floored."""
    n = len(source)
    top = (target + 1.0) * float(source.sum() + n)
    return np.floor(1000 * np.log(top / ((source + 1.0) * float(target.sum() + n)))).astype(np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """The first 32 bits of the SHA-256 of seed and id, as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def gumbel(h: np.ndarray) -> np.ndarray:
    """Thousands of Gumbel noise from 32-bit numbers, floored."""
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS,
          seed: int = SEED) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            words, features, weight = [], [], []
            for text in _texts(b):
                n, at = feature_buckets(text, max_words, len(gain))
                words.append(n)
                features.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            score = np.array(weight, np.int64) + gumbel(b.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64()),
                 pa.array(score)], ["id", "n_words", "n_features", "weight", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                      noise(F.col(id_col), seed).alias("h"))
    return map_arrow(src, run, "id long, n_words long, n_features long, weight long, score long")


# ---- parallel sorting by regular sampling ----------------------------------------

# the sort key of a row: higher scores first, then smaller ids, null ids last
_KEY = np.dtype([("down", np.int64), ("id", np.int64)])


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, _KEY)
    out["down"], out["id"] = batch.column("down").to_numpy(), batch.column("key_id").to_numpy()
    return out


def _regular_samples(per_run: int):
    """``per_run`` values at regular places of the task's sorted run, each with the rows it stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_keys(b) for b in batches]   # 16 bytes a row
        if not sum(map(len, parts)):
            return
        keys = np.concatenate(parts)
        n = min(per_run, len(keys))
        at = (np.arange(n) * len(keys)) // n
        stands = np.diff(np.append(at, len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys["down"][at]), pa.array(keys["id"][at]), pa.array(stands)],
                                         ["down", "key_id", "stands"])
    return run


def splitters(samples: np.ndarray, stands: np.ndarray, segments: int) -> np.ndarray:
    """``segments`` - 1 keys that part the rows the samples stand for evenly."""
    order = np.argsort(samples, order=("down", "id"))
    ends = np.cumsum(stands[order])
    if not len(ends):
        return samples
    cuts = np.searchsorted(ends, np.arange(1, segments) * ends[-1] / segments)
    return samples[order][cuts]


def _segments(shared):
    """The segment of each row: how many splitters are not above it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        for b in batches:
            segment = np.searchsorted(cut, _keys(b), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment)], [*b.schema.names, "segment"])
    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its segment, from 0; the rows come in order of segment and key."""
    last, seen = -1, 0
    for b in batches:
        segment = b.column("segment").to_numpy()
        if not len(segment):
            continue
        new = np.flatnonzero(np.diff(segment, prepend=last))
        start = np.full(len(segment), -seen, np.int64) if segment[0] == last else np.zeros(len(segment), np.int64)
        for at in new:
            start[at:] = at
        place = np.arange(len(segment)) - start
        last, seen = int(segment[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], [*b.schema.names, "place"])


def exact_ranks(rows: DataFrame, segments: int | None = None) -> DataFrame:
    """``rows`` (with ``score`` and ``id``) with ``rank``: 1, 2, 3, ... by score, highest first, then by id."""
    spark = rows.sparkSession
    segments = segments or shuffle_partitions(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed = rows.withColumn("down", -F.col("score")).withColumn("key_id", F.coalesce("id", F.lit(NO_ID)))
    order = ["down", "key_id"]
    runs = keyed.select(*order).sortWithinPartitions(*order)
    per_run = max(1, min(4 * segments, SAMPLES // max(1, rows.rdd.getNumPartitions())))
    found = map_arrow(runs, _regular_samples(per_run), "down long, key_id long, stands long").toArrow()
    samples = np.empty(found.num_rows, _KEY)
    samples["down"], samples["id"] = found["down"].to_numpy(), found["key_id"].to_numpy()
    cut = spark.sparkContext.broadcast(splitters(samples, found["stands"].to_numpy(), segments))
    dealt = (map_arrow(keyed, _segments(cut), f"{fields}, down long, key_id long, segment int")
             .repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", *order))
    placed = materialise(map_arrow(dealt, _places, f"{fields}, down long, key_id long, segment int, place long"), "placed")
    sizes = placed.groupBy("segment").agg(F.count("*").alias("n"))   # one row for each segment
    before = sizes.select("segment", F.coalesce(F.sum("n").over(
        Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, "segment").withColumn("rank", F.col("before") + F.col("place") + 1).select(
        *rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             max_words: int = MAX_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """Every row's ``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn)."""
    gain = gains(bucket_counts(docs, text_col, max_words, buckets), bucket_counts(target, target_text_col, max_words, buckets))
    scored = materialise(weigh(docs, gain, id_col, text_col, max_words, seed), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = exact_ranks(able)
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionAll(
        scored.where(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank")))
