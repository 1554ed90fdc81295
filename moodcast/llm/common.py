"""Shared helpers: tables in the shared folder, vectorised text hashing, grouped streaming."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import moodcast
from moodcast.session import checkpoint_dir

# Characters handled at once by the vectorised helpers: bounds their memory
# (about 40 bytes a character) and keeps the arrays in the CPU's cache.
CHUNK_CHARS = 1 << 18

_U = np.uint64
_ALNUM: np.ndarray | None = None


# ---- tables in the shared folder -----------------------------------------

def materialise(df: DataFrame, name: str, scoped: bool = True) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with a table every executor can read, so a lost executor
    costs only its running tasks. Values made by ``monotonically_increasing_id``
    become stable here.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    if scoped and _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that no later step reads."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


_SCOPES: list[list[str]] = []   # tables to delete, a list for each open scope


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all that ``materialise`` wrote inside, but for tables with ``scoped=False``.

    What a caller keeps of the work inside has to be written by then.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(moodcast.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "moodcast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package importable on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- vectorised text helpers -----------------------------------------------

def alnum_table() -> np.ndarray:
    """Per code point: does ``str.isalnum`` hold."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _ALNUM


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0x9E3779B97F4A7C15)
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    p = np.full(max(n, 1), _U(base), dtype=_U)
    p[0] = _U(1)
    return np.cumprod(p, dtype=_U)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` characters (one text at least)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each followed by a 0; start of each text (and the end)."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts`` and each text's word range (offsets, one more than texts).

    A word is a maximal run of letters and digits (``str.isalnum``) of the
    lower-cased text.
    """
    codes, starts = code_points([t.lower() for t in texts])
    is_word = alnum_table()[codes]
    idx = np.flatnonzero(is_word)
    if not len(idx):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    first = np.ones(len(idx), bool)
    first[1:] = idx[1:] != idx[:-1] + 1
    at = np.flatnonzero(first)
    lens = np.diff(np.append(at, len(idx)))
    off = np.arange(len(idx)) - np.repeat(at, lens)
    h = (codes[idx].astype(_U) + _U(1)) * powers(int(lens.max()))[off]
    hashes = mix(np.add.reduceat(h, at))
    return hashes, np.searchsorted(idx[at], starts)


_MULT = mix(np.arange(1, 1025, dtype=_U)) | _U(1)


def window_hashes(words: np.ndarray, positions: Iterable[int]) -> np.ndarray:
    """Hash of the words at ``i + p`` for p in positions, for every i where all exist."""
    positions = list(positions)
    n = len(words) - max(positions)
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k, p in enumerate(positions):
        out += words[p:p + n] * _MULT[k]
    return mix(out)


def text_slices(batch: pa.RecordBatch, name: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``limit`` bytes of the text column (one row at least), with their texts (null: empty).

    Strings are made for one range at a time, so a batch of long texts isn't held twice.
    """
    column = batch.column(name)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi, ["" if t is None else t for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


# ---- streaming over sorted groups --------------------------------------------

def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterable[pa.RecordBatch]],
             schema: str, partitions: int | None = None) -> DataFrame:
    """``fn`` over the rows of each key, streamed from sorted partitions.

    Many small keys share a task without one Python call of Spark's each; only
    one key's rows are held at a time, so callers bound the rows of a key (by
    splitting keys into blocks).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = tuple(c[lo] for c in cols)
                if held and key != last:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = key
        if held:
            yield from fn(pa.Table.from_batches(held))

    n = partitions or shuffle_partitions(df.sparkSession)
    return map_arrow(df.repartition(n, *keys).sortWithinPartitions(*keys), run, schema)


# ---- SQL expressions ---------------------------------------------------------

BLOCK = 512   # values of a running total that are folded one by one


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is computed once a row (a lambda's argument)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, op: str) -> str:
    """SQL: the running result of ``op`` (of ``a`` and ``b``, from 0 on) over an array of whole numbers that are not negative.

    Folds append to arrays of at most ``BLOCK`` values; the blocks' totals are
    then folded and added, so the work is in proportion to the array.
    """
    def fold(array: str, value: str, kept: str) -> str:
        step = op.format(a="t.s", b=value)
        return (f"aggregate({array}, named_struct('s', 0, 'o', cast(array() as array<int>)), "
                f"(t, y) -> named_struct('s', {step}, 'o', array_append(t.o, {kept.format(step=step)})), t -> t.o)")

    parts = (f"transform(sequence(0, (size(rv) - 1) div {BLOCK}), "
             f"rb -> {fold(f'slice(rv, cast(rb * {BLOCK} + 1 as int), {BLOCK})', 'y', '{step}')})")
    whole = (f"flatten(zip_with(rp, {fold('rp', 'element_at(y, -1)', 't.s')}, "
             f"(rl, rs) -> transform(rl, x -> {op.format(a='rs', b='x')})))")
    return let("rv", values, f"if(size(rv) = 0, rv, {let('rp', parts, whole)})")


def quoted(pattern: str) -> str:
    """SQL literal of a regular expression."""
    return "r'" + pattern.replace("'", "\\x27") + "'"
