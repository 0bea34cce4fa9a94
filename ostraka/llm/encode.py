"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens, and every pre-token is resolved by a two-tier lookup:

1. a minimal perfect hash over the vocabulary finds pre-tokens that are whole vocabulary
   entries; the stored bytes are compared, so a foreign pre-token never passes for an entry;
2. each distinct miss is merged once per worker with a heap of candidate merges over its
   doubly linked bytes.

Both run over Arrow batches with numpy: cutting, hashing, lookup and the assembly of the id
lists touch whole batches, and only distinct misses reach a Python loop. There is no shuffle.
The vocabulary (its size is fixed by the public file) is broadcast once.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text handled at once; a longer text is still encoded whole.
SLICE_BYTES = 1 << 20

_U64 = np.uint64
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


# --- pre-tokens ----------------------------------------------------------------------------


# Letters and numbers that Unicode 16 added, which Python's own tables lack.
_NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
_WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(cp))[0], _OTHER) for cp in range(sys.maxunicode + 1)], np.uint8)
    for ranges, kind in ((_NEW_LETTERS, _LETTER), (_NEW_NUMBERS, _NUMBER), (_WHITE, _SPACE)):
        for lo, hi in ranges:
            table[lo:hi + 1] = kind
    return table


_CLASS: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    return _CLASS


def cut_points(cps: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions at which a pre-token begins.

    The grammar: a contraction; else one optional blank and a run of letters, of numbers or of
    other signs; else white space, of which the last before a sign stands alone.
    """
    n = len(cps)
    kind = _class_table()[cps]
    first = np.zeros(n + 1, bool)  # first code points of documents, and the end
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= first[:n]
    space = kind == _SPACE
    # the last white space before a sign of the same document
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    blank = last & (cps == 0x20)
    start = begin | last
    start[1:] &= ~blank[:-1]  # the run after a blank begins at the blank
    # contractions: an apostrophe that begins a match, then s t m d or re ve ll
    apo = np.flatnonzero((cps == 0x27) & start)
    if len(apo):
        pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
        ends = np.concatenate([first, np.ones(2, bool)])  # no contraction crosses documents
        a, b = pad[apo + 1], pad[apo + 2]
        ok1 = ~ends[apo + 1]
        one = ok1 & np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        two = ok1 & ~ends[np.minimum(apo + 2, n + 1)] & (
            ((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C))
        )
        for mask, width in ((one, 2), (two, 3)):
            at = apo[mask]
            start[at + 1] = False
            nxt = at + width
            nxt = nxt[nxt < n]
            start[nxt] |= kind[nxt] == _LETTER
    return start


# --- tier 1: minimal perfect hash ----------------------------------------------------------


def _byte_values() -> np.ndarray:
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 2**64, 256, dtype=np.uint64) | _U64(1)


_BYTE = _byte_values()
_P = _U64(0x9E3779B97F4A7C15)
_P_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_pow_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice ``data[starts[i]:ends[i]]``."""
    n = len(data)
    if len(_pow_cache[0]) <= n:
        size = max(n + 1, SLICE_BYTES)
        _pow_cache[0], _pow_cache[1] = _powers(_P, size), _powers(_P_INV, size)
    up, down = _pow_cache
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=acc[1:])
        h = (acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        return _mix(h)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U64(31))
        h = h * _U64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> _U64(29))
        h = h * _U64(0x94D049BB133111EB)
        return h ^ (h >> _U64(32))


@dataclass
class PerfectHash:
    """Hash and displace: ``shift[h % buckets]`` sends each key's hash to a slot of its own."""

    shift: np.ndarray  # int64; below 0: the slot of a bucket's only key
    slots: int

    def slot(self, h: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % _U64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, _slot(h, shift, self.slots))


def _slot(h: np.ndarray, shift, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        moved = _mix(h + np.asarray(shift).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))
    return (moved % _U64(slots)).astype(np.int64)


def build_perfect_hash(hashes: np.ndarray) -> PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes (as many slots as keys)."""
    n = len(hashes)
    if len(np.unique(hashes)) != n:
        raise ValueError("hashes are not distinct")
    buckets = max(1, n // 4)
    where = (hashes % _U64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    counts = np.bincount(where, minlength=buckets)
    begins = np.concatenate([[0], np.cumsum(counts)])
    shift = np.zeros(buckets, np.int64)
    taken = np.zeros(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        keys = hashes[order[begins[b]:begins[b + 1]]]
        if len(keys) < 2:
            break
        base = 0
        while True:
            tries = np.arange(base, base + 64, dtype=np.int64)
            slots = _slot(keys[None, :], tries[:, None], n)
            s = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                shift[b] = tries[k]
                taken[slots[k]] = True
                break
            base += 64
    free = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(counts == 1):
        shift[b] = -int(next(free)) - 1
    return PerfectHash(shift, n)


# --- tier 2: heap over linked bytes --------------------------------------------------------


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank, leftmost first, merges until none is left."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # end of the part that begins here
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has merged since
        alive[j] = False
        end[i] = stop
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get(piece[i:end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:stop])
            if r is not None:
                heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = after[i]
    return out


# --- the encoder ---------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """A rank file with its perfect hash; what the broadcast holds."""

    entries: list[bytes]
    table: PerfectHash
    entry_at: np.ndarray  # slot -> id

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        entries: list[bytes] = [b""] * len(pairs)
        for word, rank in pairs:
            entries[int(rank)] = base64.b64decode(word)
        data = np.frombuffer(b"".join(entries), np.uint8)
        ends = np.cumsum([len(e) for e in entries])
        hashes = slice_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
        table = build_perfect_hash(hashes)
        entry_at = np.zeros(len(entries), np.int32)
        entry_at[table.slot(hashes)] = np.arange(len(entries), dtype=np.int32)
        return cls(entries, table, entry_at)


class Encoder:
    """Encodes batches of UTF-8 texts; remembers the distinct misses of its worker."""

    MEMORY = 1 << 20  # distinct misses kept; beyond it the memory starts afresh

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ranks = {e: i for i, e in enumerate(vocabulary.entries)}
        self.blob = np.frombuffer(b"".join(vocabulary.entries), np.uint8)
        self.size = np.array([len(e) for e in vocabulary.entries], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.known: dict[bytes, list[int]] = {}

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list offsets, ids) of the texts ``data[offsets[i]:offsets[i+1]]``."""
        if not data:
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.int32)
        raw = np.frombuffer(data, np.uint8)
        text = data.decode("utf-8", "surrogateescape")
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(cps) == len(raw):
            where, docs = None, offsets[:-1]
        else:
            width = np.ones(len(cps), np.int64)
            width += cps >= 0x80
            width += cps >= 0x800
            width += cps >= 0x10000
            width[(cps >= 0xDC80) & (cps <= 0xDCFF)] = 1
            where = np.concatenate([[0], np.cumsum(width)])
            docs = np.searchsorted(where, offsets[:-1])
        starts = np.flatnonzero(cut_points(cps, docs))
        if where is not None:
            starts = where[starts]
        ends = np.concatenate([starts[1:], [len(raw)]])
        count, ids = self._resolve(raw, data, starts, ends)
        total = np.concatenate([[0], np.cumsum(count)])
        return total[np.searchsorted(starts, offsets)], ids

    def _same(self, raw, starts, sizes, other, other_starts) -> np.ndarray:
        """Whether each slice of ``raw`` equals the slice of ``other`` of the same size."""
        begin = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
        equal = raw[np.repeat(starts, sizes) + inner] == other[np.repeat(other_starts, sizes) + inner]
        return np.logical_and.reduceat(equal, begin[:-1]) if len(sizes) else np.zeros(0, bool)

    def _resolve(self, raw, data, starts, ends):
        sizes = ends - starts
        h = slice_hashes(raw, starts, ends)
        entry = self.v.entry_at[self.v.table.slot(h)].astype(np.int64)
        hit = self.size[entry] == sizes
        at = np.flatnonzero(hit)
        hit[at] = self._same(raw, starts[at], sizes[at], self.blob, self.at[entry[at]])
        miss = np.flatnonzero(~hit)
        count = np.ones(len(starts), np.int64)
        if not len(miss):
            return count, entry.astype(np.int32)
        _, rep, which = np.unique(h[miss], return_index=True, return_inverse=True)
        model = miss[rep]
        agrees = self._same(raw, starts[miss], sizes[miss], raw, starts[model[which]]) & (sizes[miss] == sizes[model[which]])
        if not agrees.all():  # two pre-tokens with one hash: take each such occurrence by itself
            odd = np.flatnonzero(~agrees)
            which = which.copy()
            which[odd] = len(model) + np.arange(len(odd))
            model = np.concatenate([model, miss[odd]])
        if len(self.known) > self.MEMORY:
            self.known.clear()
        parts = []
        for s, e in zip(starts[model].tolist(), ends[model].tolist()):
            piece = data[s:e]
            ids = self.known.get(piece)
            if ids is None:
                ids = merge_bytes(piece, self.ranks)
                if len(piece) <= 256:
                    self.known[piece] = ids
            parts.append(ids)
        sizes_of = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter((i for p in parts for i in p), np.int32, int(sizes_of.sum()))
        flat_at = np.concatenate([[0], np.cumsum(sizes_of)[:-1]])
        count[miss] = sizes_of[which]
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int32)
        at = np.flatnonzero(hit)
        out[begin[at]] = entry[at]
        n = count[miss]
        total = np.concatenate([[0], np.cumsum(n)])
        inner = np.arange(total[-1]) - np.repeat(total[:-1], n)
        out[np.repeat(begin[miss], n) + inner] = flat[np.repeat(flat_at[which], n) + inner]
        return count, out


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    return (data.to_pybytes() if lo == 0 and hi == data.size else bytes(memoryview(data)[lo:hi])) if data and hi > lo else b"", offsets - lo


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(``key``, ids array<int>): the token ids of each text, without special tokens.

    Every row of ``documents`` gives a row, in repeated rows too. A null and an empty text have
    the empty list. Texts are taken unchanged and whole; strings that spell special tokens are
    ordinary text. Other columns are not read.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(os.path.join(folder, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            data, offsets = _texts(batch.column(1))
            pos, n = 0, len(offsets) - 1
            while pos < n:
                stop = int(np.searchsorted(offsets, offsets[pos] + SLICE_BYTES, "right")) - 1
                stop = min(n, max(stop, pos + 1))
                lo, hi = int(offsets[pos]), int(offsets[stop])
                lists, ids = encoder.encode(data[lo:hi], offsets[pos:stop + 1] - lo)
                column = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(pos, stop - pos), column], ["key", "ids"])
                pos = stop

    key_type = documents.schema[key].dataType.simpleString()
    chosen = documents.select(documents[key].alias("key"), documents[text].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"key {key_type}, ids array<int>").withColumnRenamed("key", key)
