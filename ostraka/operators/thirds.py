"""Pairs of records that a third record spans, without a table of the places where records meet.

Records that share a run grow with the square of the collection, and all that is asked of them is
whether a pair has a witness. Records are therefore dealt into blocks: a kernel makes an index of the
runs of its block and looks for witnesses of every pair among it, in ever larger portions, so that a
pair needs no more of them than it takes to find one. Only numbers of pairs leave a block.

Tokens are told apart by 64 bits, as are runs of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: Records of a block, of its first portion, pairs read and places looked at together: sizes of work, not limits of the result.
BLOCK, PORTION, PAIRS, PLACES = 30_000, 500, 8192, 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _grams(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of every run of ``n`` tokens."""
    size = np.diff(lists.offsets.to_numpy())
    tokens = lists.flatten().to_numpy().view(np.uint64)
    many = np.maximum(size - n + 1, 0)
    row = np.repeat(np.arange(len(size)), many)
    position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = position + np.repeat(np.cumsum(size) - size, many)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = (h ^ tokens[at + k]) * _A
        h = (h ^ (h >> np.uint64(32))) * _B
    return row, position, h


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


class _Block:
    """The runs of ``n`` tokens of a block of records: by portion and run the records with their first and last place."""

    def __init__(self, ids: np.ndarray, lists: pa.Array, n: int):
        self.ids, self.n = ids, n
        row, position, h = _grams(lists, n)
        self.known, gram = np.unique(h, return_inverse=True)
        order = np.lexsort((position, row, gram))
        gram, row, position = gram[order], row[order], position[order]
        first = _starts(gram, row)
        last = np.append(first[1:], len(row)) - 1
        gram, row, low, high = gram[first], row[first], position[first], position[last]
        self.portions = []
        a, size = 0, PORTION
        while a < len(ids):
            here = np.flatnonzero((row >= a) & (row < a + size))  # sorted by run
            many = np.bincount(gram[here], minlength=len(self.known))
            self.portions.append((many, np.cumsum(many) - many, row[here], low[here], high[here]))
            a, size = a + size, 2 * size

    def asked(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, run) of the distinct runs that the block knows."""
        row, _, h = _grams(lists, self.n)
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        there = self.known[at] == h
        both = np.unique(row[there] * len(self.known) + at[there])
        return both // len(self.known), both % len(self.known)

    def covered(self, a: np.ndarray, b: np.ndarray, runs_a: pa.Array, runs_b: pa.Array) -> np.ndarray:
        """Whether a record of the block other than ``a`` and ``b`` spans the pair."""
        found = np.zeros(len(a), bool)
        sides = [self.asked(x) for x in (runs_a, runs_b)]
        for many, begin, row, low, high in self.portions:
            places = []
            for of, gram in sides:
                places.append(np.bincount(of, many[gram], len(a)).astype(np.int64))
            left = np.flatnonzero(~found & (places[0] > 0) & (places[1] > 0))
            total = np.cumsum((places[0] + places[1])[left])
            s = 0
            while s < len(left):
                e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PLACES, "right")))
                self._mark(found, left[s:e], sides, many, begin, row, low, high, a, b)
                s = e
        return found

    def _mark(self, found: np.ndarray, pairs: np.ndarray, sides: list, many: np.ndarray, begin: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        met, width = [], len(self.ids)
        for of, gram in sides:
            at = np.concatenate([np.zeros(0, np.int64), _each(np.searchsorted(of, pairs, "right") - np.searchsorted(of, pairs), np.searchsorted(of, pairs))])
            of, gram = of[at], gram[at]
            n = many[gram]
            x = _each(n, begin[gram])
            key = np.repeat(of, n) * width + row[x]
            order = np.argsort(key)
            key, x = key[order], x[order]
            first = _starts(key)
            met.append((key[first], np.minimum.reduceat(low[x], first), np.maximum.reduceat(high[x], first)))
        (ka, la, ha), (kb, lb, hb) = met
        _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        pair, w = ka[i] // width, self.ids[ka[i] % width]
        apart = (ha[i] - lb[j] >= self.n) | (hb[j] - la[i] >= self.n)
        found[pair[apart & (w != a[pair]) & (w != b[pair])]] = True


def _each(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, as many as ``counts`` has."""
    return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


def covered(records: DataFrame, pairs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``pairs`` for each n of ``lengths``, with n and s: 1 where a third record holds a run of ``n`` tokens of one and, apart from it, one of the other, else null.

    ``records`` has fragment_id and tokens, ``pairs`` the columns a and b; pairs without both records are left out.
    Of all places where a witness meets a record the first and the last decide whether two places lie apart.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "thirds")
    coded = scratch.cut(records.select("fragment_id", F.xxhash64("fragment_id").alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")), "records")
    asked = pairs
    for c in ("a", "b"):
        asked = asked.join(coded.select(F.col("fragment_id").alias(c), F.col("id").alias(f"i{c}"), F.col("h").alias(f"h{c}")), c)
    asked = scratch.cut(asked.withColumn("k", F.monotonically_increasing_id()), "pairs")
    root = scratch.root

    def read() -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(f"{root}/pairs")
        for info in where.get_file_info(fs.FileSelector(path)):
            if info.path.endswith(".parquet"):
                with where.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).iter_batches(PAIRS, columns=["k", "ia", "ib", "ha", "hb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("id", pa.int64()), ("h", pa.list_(pa.int64()))])).combine_chunks()
        if not held.num_rows:
            return
        blocks = [_Block(held["id"].to_numpy(), held["h"].combine_chunks(), n) for n in lengths]
        del held
        for batch in read():
            k, a, b = (batch.column(c).to_numpy() for c in ("k", "ia", "ib"))
            for block in blocks:
                found = k[block.covered(a, b, batch.column("ha"), batch.column("hb"))]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), block.n, np.int32))], ["k", "n"])

    n_records = coded.count()
    dealt = coded.select("id", "h").repartition(max(1, min(spark.sparkContext.defaultParallelism, n_records // 2000), -(-n_records // BLOCK)))
    spanned = dealt.mapInArrow(run, "k long, n int").distinct().withColumn("s", F.lit(1))
    each = asked.drop("ia", "ib", "ha", "hb").withColumn("n", F.explode(F.array(*map(F.lit, lengths))))
    return each.join(spanned, ["k", "n"], "left").drop("k")
