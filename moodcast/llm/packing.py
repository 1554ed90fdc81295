"""Packing of tokenised examples into fixed-length sequences by vector bin packing.

An example asks for a vector of (tokens, 1 segment, loss-bearing tokens) and a
sequence has a capacity in each. Examples longer than a sequence are cut into
whole sequences and a rest. Each task packs its own examples: it holds a pool
of bounded size, opens one sequence at a time and keeps placing the fitting
piece with the largest dot product of its vector and the remaining capacity
(both in shares of the capacity). Where nothing fits any more and at least
``MIN_CUT`` tokens are free, the piece with the largest dot product is cut to
fill the sequence. So all sequences are full to within ``MIN_CUT`` tokens, but for those closed by
another limit and the last one of each task.

The ids are those of the tokenizer's file, also where a text holds the string of
an added token.

Defined cases: a null text is empty and has only the end id; repeated rows are
packed each; a null id stays null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import code_points, map_arrow, mix, powers, text_slices

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
MIN_CUT = 8
MAX_LOSS = MAX_TOKENS - MIN_CUT   # a few tokens of every full sequence bear no loss
POOL = 1024            # pieces a task holds while packing
END_ID = 1
CACHE_BITS = 20        # slots of the pre-tokens a task remembers (2^20, 12 MB)
CACHE_ENTRIES = 500_000   # pre-tokens encoded before it forgets them all

_U = np.uint64
_SEP, _LETTER, _NUMBER, _SPACE, _OTHER = range(5)


class WordTokenizer:
    """Ids of whole texts, with each distinct pre-token encoded once while it is remembered.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are
    those of its pre-tokens in order. Pre-tokens are cut by the published
    pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    ``encode`` takes added tokens' strings for ordinary text; ``encode_as_file`` gives
    the ids of the tokenizer's file, where texts that hold such a string (they are
    rare) are encoded whole by the library.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)   # bytes of each id
        for word, i in vocabulary.items():   # byte-level: a character stands for a byte
            self.width[i] = len(word)
        self.kind = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for code, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, z = ord(every[m.start()]), ord(every[m.end() - 1])
                self.kind[a:z + 1] = code
        self.kind[0xD800:0xE000] = _OTHER
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens."""
        self.known, self.entry = np.zeros(0, _U), np.zeros(0, np.int32)
        self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids, self.used, self.entries = np.zeros(1 << 18, np.int32), 0, 0

    def _cuts(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each pre-token and of each mark between texts; which are pre-tokens."""
        kind = self.kind[codes]
        seps = starts[1:] - 1
        kind[seps] = _SEP
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[seps] = True
        cut[starts[1:]] = True
        bounds = np.flatnonzero(cut)
        first, after = bounds[:-1], bounds[1:]
        run = kind[first]
        # the last white space before other text stands alone, or belongs to that text if it is a space
        space = np.flatnonzero((run == _SPACE) & (kind[np.minimum(after, len(kind) - 1)] != _SEP))
        last = after[space] - 1
        cut[last] = True
        joins = codes[last] == 0x20
        cut[after[space][joins]] = False
        # contractions: an apostrophe that starts a pre-token, and the letters after it
        apo = first[(run == _OTHER) & (codes[first] == 0x27) & (after - first == 1)]
        apo = apo[cut[apo] & (kind[np.minimum(apo + 1, len(kind) - 1)] == _LETTER)]
        if len(apo):
            a, b = codes[apo + 1], codes[np.minimum(apo + 2, len(codes) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            size = np.where(one, 1, np.where(two, 2, 0))
            apo, size = apo[size > 0], size[size > 0]
            cut[apo + 1] = False
            cut[apo + 1 + size] = True
        bounds = np.flatnonzero(cut)
        return bounds[:-1], bounds[1:], kind[bounds[:-1]] != _SEP

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's range of them (offsets); added tokens' strings are ordinary text."""
        codes, starts = code_points(texts)
        first, after, real = self._cuts(codes, starts)
        at = np.zeros(len(codes), np.int32)
        at[first] = first
        off = np.arange(len(codes), dtype=np.int32) - np.maximum.accumulate(at)
        h = (codes + np.uint32(1)) * powers(int((after - first).max()))[off]
        h = mix(np.add.reduceat(h, first))[real]
        first, after = first[real], after[real]
        if not len(h):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if not len(self.known):
            self.known = np.zeros(1 << CACHE_BITS, _U)            # a pre-token's hash, at the slot it picks
            self.entry = np.zeros(1 << CACHE_BITS, np.int32)      # and its entry below
        slot = (h & _U((1 << CACHE_BITS) - 1)).astype(np.int64)
        hit = self.known[slot] == h
        if hit.all():
            entry = self.entry[slot]
        else:
            miss = np.flatnonzero(~hit)
            keys, example, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.entries and self.entries + len(keys) > CACHE_ENTRIES:
                self.clear()
                return self.encode(texts)
            entry = self.entry[slot]
            new = self._learn(texts, starts, first[miss[example]], after[miss[example]])
            entry[miss] = new[inverse]
            self.known[slot[miss[example]]] = keys
            self.entry[slot[miss[example]]] = new
        return self._assemble(entry, first, starts)

    def encode_as_file(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's range of them (offsets), as the tokenizer's file says."""
        rare = [i for i, t in enumerate(texts) if self.added.search(t)] if self.added else []
        if not rare:
            return self.encode(texts)
        aside = set(rare)
        ids, off = self.encode(["" if i in aside else t for i, t in enumerate(texts)])
        parts = [ids[off[i]:off[i + 1]] for i in range(len(texts))]
        self.tokenizer.encode_special_tokens = False   # one tokenizer in memory for both
        for i in rare:
            parts[i] = self._encode(texts[i])
        self.tokenizer.encode_special_tokens = True
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    def _assemble(self, entry, first, starts) -> tuple[np.ndarray, np.ndarray]:
        n = self.length[entry]
        ends = np.cumsum(n, dtype=np.int64)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.start[entry] - (ends - n), n)]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(first, starts)]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, texts, starts, first, after) -> np.ndarray:
        """Entries of new pre-tokens."""
        doc = (np.searchsorted(starts, first, "right") - 1)
        a, z = (first - starts[doc]).tolist(), (after - starts[doc]).tolist()
        words = [texts[d][x:y] for d, x, y in zip(doc.tolist(), a, z)]
        # a pre-token of a space and something else stays one when many are joined
        joined = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and self.kind[ord(w[1])] != _SPACE]
        ids = self._encode("".join([words[i] for i in joined]))
        size = np.cumsum([len(words[i].encode("utf-8", "surrogatepass")) for i in joined])
        ends = np.searchsorted(np.cumsum(self.width[ids]), size) + 1
        lens = np.zeros(len(words), np.int32)
        begin = np.zeros(len(words), np.int32)
        lens[joined] = np.diff(ends, prepend=0)
        begin[joined] = ends - lens[joined]
        rest, parts, top = sorted(set(range(len(words))) - set(joined)), [ids], len(ids)
        for i in rest:
            one = self._encode(words[i])
            begin[i], lens[i] = top, len(one)
            parts.append(one)
            top += len(one)
        while self.used + top > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.entries + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        entry = np.arange(self.entries, self.entries + len(words), dtype=np.int32)
        self.ids[self.used:self.used + top] = np.concatenate(parts)
        self.start[entry], self.length[entry] = begin + self.used, lens
        self.used += top
        self.entries += len(words)
        return entry


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file in a worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS
    min_cut: int = MIN_CUT


@dataclass
class Packer:
    """Packs pieces of examples; ``add`` and ``finish`` give (example, start, length, sequence, offset).

    An example's loss-bearing tokens are its ids from ``loss_from`` to ``loss_to``.
    """

    limits: Limits = field(default_factory=Limits)
    pool: int = POOL
    sequences: int = 0

    def __post_init__(self) -> None:
        self.open = np.zeros(self.pool, bool)
        self.owner: list = [None] * self.pool
        self.at = np.zeros(self.pool, np.int64)    # first id of the piece in its example
        self.ask = np.zeros((self.pool, 3))        # tokens, segments, loss-bearing tokens
        self.size = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)

    def add(self, example: object, length: int, loss_from: int, loss_to: int) -> Iterator[tuple]:
        """Take an example of ``length`` ids; sequences that are ready come back."""
        at = 0
        while length - at > 0:
            n = self._longest(length - at, at, loss_from, loss_to, self.limits.tokens, self.limits.loss)
            if n < length - at:   # cut: a sequence of its own
                yield example, at, n, self._next(), 0
                at += n
                continue
            if self.open.all():
                yield from self._pack(self.pool // 2)
            slot = int(np.argmin(self.open))
            self.open[slot], self.owner[slot], self.at[slot] = True, (example, length, loss_from, loss_to), at
            self.ask[slot] = n, 1, self._loss(at, n, loss_from, loss_to)
            return

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    @staticmethod
    def _loss(at: int, n: int, loss_from: int, loss_to: int) -> int:
        return max(0, min(at + n, loss_to) - max(at, loss_from))

    @staticmethod
    def _longest(n: int, at: int, loss_from: int, loss_to: int, tokens: int, loss: int) -> int:
        """Ids from ``at`` on, at most n, that keep within tokens and loss."""
        n = min(n, tokens)
        room = max(at, loss_from) + loss
        return n if loss_to <= room else max(0, min(n, room - at))

    def _pack(self, down_to: int) -> Iterator[tuple]:
        """Fill sequences until at most ``down_to`` pieces are in the pool."""
        while self.open.sum() > down_to:
            left, offset, seq = self.size.copy(), 0, self._next()
            while True:
                live = np.flatnonzero(self.open)
                if not len(live) or left[1] < 1 or left[0] < 1:
                    break
                ask = self.ask[live]
                dot = (ask / self.size) @ (left / self.size)
                fits = (ask <= left).all(axis=1)
                if fits.any():
                    slot = int(live[np.argmax(np.where(fits, dot, -1.0))])
                    n = int(ask[np.searchsorted(live, slot), 0])
                else:
                    slot = int(live[np.argmax(dot)])
                    owner = self.owner[slot]
                    n = self._longest(int(self.ask[slot, 0]), int(self.at[slot]), *owner[2:], int(left[0]), int(left[2]))
                    if n < self.limits.min_cut:
                        break
                example, length, loss_from, loss_to = self.owner[slot]
                at = int(self.at[slot])
                yield example, at, n, seq, offset
                offset += n
                left -= (n, 1, self._loss(at, n, loss_from, loss_to))
                rest = int(self.ask[slot, 0]) - n
                if rest:
                    self.at[slot] = at + n
                    self.ask[slot] = rest, 1, self._loss(at + n, rest, loss_from, loss_to)
                else:
                    self.open[slot], self.owner[slot] = False, None


def _loss_range(values: tuple, length: int) -> tuple[int, int]:
    """Loss-bearing ids of an example of ``length`` ids and the end id, which never bears loss."""
    low, high = values
    low = 0 if low is None else min(max(low, 0), length)
    return low, max(low, length if high is None else min(high, length))


def _run(path: str, limits: Limits, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(path), Packer(limits)
        first = TaskContext.get().partitionId() << 33
        end = np.array([end_id], np.int32)
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ids, at, n, doc, data, seq, off = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(data, pa.binary()), pa.array(doc, pa.int64()),
                 pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def row(piece) -> tuple:
            (key, ids), at, n, seq, off = piece
            return key, at, n, len(ids), ids[at:at + n].astype("<u4").tobytes(), first + seq, off

        def pieces():
            for b in batches:
                keys = b.column("id").to_pylist()
                loss = list(zip(b.column("loss_from").to_pylist(), b.column("loss_to").to_pylist()))
                for lo, hi, texts in text_slices(b, "text"):
                    ids, off = tokenizer.encode_as_file(texts)
                    for i, key in enumerate(keys[lo:hi]):
                        mine = np.concatenate([ids[off[i]:off[i + 1]], end])
                        yield from packer.add((key, mine), len(mine), *_loss_range(loss[lo + i], len(mine) - 1))
            yield from packer.finish()

        for p in pieces():
            out.append(row(p))
            size += p[2]
            if size > 1 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()
        tokenizer.clear()   # the worker lives on, other stages need its memory
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   limits: Limits = Limits(), end_id: int = END_ID, loss_from_col: str | None = None,
                   loss_to_col: str | None = None) -> DataFrame:
    """One row for each piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset in the sequence.

    ``loss_from_col`` and ``loss_to_col`` name columns with the range of loss-bearing ids (end exclusive; not
    given or null: all ids of the text). The end id bears no loss.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      *[(F.lit(None) if c is None else F.col(c)).cast("long").alias(n)
                        for c, n in ((loss_from_col, "loss_from"), (loss_to_col, "loss_to"))])
    id_field = src.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return map_arrow(src, _run(tokenizer_path, limits, end_id, to_arrow_type(id_field)),
                     f"id {id_field.simpleString()}, start long, length long, ids binary, doc_tokens long, "
                     "sequence_id long, offset long").withColumnRenamed("id", id_col)
