"""Evaluation texts leaking into training text: BM25 retrieval with block maxima, then exact overlap.

The index terms are runs of three words with BM25 weights (single words are shared by all texts
of a language and tell nothing apart); items are laid out in blocks, and for each term and block
the largest weight is kept. Each training document is cut into overlapping passages, short enough
to be telling and so placed that every run of ``min_words`` words lies whole in one passage, and
every passage is a query:

* the sum of block maxima bounds the score of all items of a block, so blocks whose bound stays
  below every threshold in them are skipped (the block-max test of WAND);
* in the blocks left, items whose own score reaches their threshold are retrieved;
* a retrieved pair is a leak if ``min_words`` consecutive words of the item, question and answer
  alike, stand consecutively in the passage.

An item's threshold is the least score any of its own windows of ``min_words`` words can have.
A passage that holds such a window has all its words and so scores no less: retrieval above the
threshold loses no leak. There is no limit on the number of items retrieved.

The items are the stated query set; the documents are never shuffled and read once. Tasks over the
items build the index in shards of at most ``SHARD_WORDS`` words; long items are cut into pieces that
overlap so that every run of ``min_words`` words lies whole in one, so no shard is larger, however
long an item is. Each shard is broadcast by itself; a task over the documents takes a stretch of
them, asks all shards in turn, and keeps few of them in memory.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

MIN_WORDS = 20
#: Words of a shard and of a piece of an item: what is broadcast is bounded by the first.
SHARD_WORDS, PIECE_WORDS = 1 << 18, 1 << 16
#: Shards a task keeps in memory; where there are more it reads them again for each stretch of documents.
KEPT = 4
BLOCK = 16
K1, B = 1.5, 0.75
#: The characters freed from texts before words are cut.
_DROPPED = "[]⸢⸣"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Scores are sums of float32 weights; a threshold is lowered by this share so rounding loses nothing.
_SLACK = 1e-4


def words(text: str) -> list[str]:
    """Words of a text: composed, lower-cased, freed of editorial brackets, cut at anything but letters, marks and numbers."""
    text = unicodedata.normalize("NFC", text).lower()
    for c in _DROPPED:
        if c in text:
            text = text.replace(c, "")
    return _WORD.findall(text)


@dataclass
class ItemIndex:
    """Inverted index of one shard of items with BM25 weights, block maxima and thresholds.

    Postings and block maxima are sparse, by term: those of term t stand at ``at[t]`` to ``at[t + 1]``.
    """

    vocabulary: dict[str, int]
    grams: np.ndarray  # sorted keys of the index terms
    block_at: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    threshold: np.ndarray  # by item position
    least: np.ndarray  # least threshold by block
    item_ids: list[int]
    numbered: list[np.ndarray]  # by item position: its word numbers
    min_words: int

    @classmethod
    def build(cls, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS) -> ItemIndex:
        """``items`` are (id, words), each of at least ``min_words`` words; an id may come in several pieces."""
        # items of one language and kind lie together, which keeps the maxima of other blocks low
        texts = sorted(items, key=lambda x: (sorted(x[1])[len(x[1]) // 2], x[0]))
        vocabulary: dict[str, int] = {}
        numbered = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for _, ws in texts]
        keys = [_gram_keys(ids) for ids in numbered]
        grams = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        terms = [np.searchsorted(grams, k) for k in keys]
        n = len(texts)
        df = np.zeros(len(grams))
        for t in terms:
            df[np.unique(t)] += 1
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        mean = sum(map(len, terms)) / max(1, n)
        threshold = np.zeros(n)
        wide = min_words - 2  # terms in a window
        of, who, how = [], [], []
        for k, t in enumerate(terms):
            u, at, tf = np.unique(t, return_inverse=True, return_counts=True)
            w = idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            of.append(u)
            who.append(np.full(len(u), k))
            how.append(w)
            threshold[k] = min(float(w[np.unique(at[s:s + wide])].sum()) for s in range(len(t) - wide + 1)) * (1 - _SLACK)
        term, item, weight = (np.concatenate(x) if x else np.zeros(0) for x in (of, who, how))
        order = np.lexsort((item, term))
        term, item, weight = term[order].astype(np.int64), item[order].astype(np.int64), weight[order]
        item_at = np.searchsorted(term, np.arange(len(grams) + 1))
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)])) if len(term) else np.zeros(0, np.int64)
        block_max = np.maximum.reduceat(weight, first) if len(first) else weight
        block_at = np.searchsorted(term[first], np.arange(len(grams) + 1))
        least = np.array([threshold[b:b + BLOCK].min() for b in range(0, n, BLOCK)])
        return cls(vocabulary, grams, block_at, item[first] // BLOCK, block_max, item_at, item, weight, threshold, least, [i for i, _ in texts], numbered, min_words)

    def _window_set(self, item: int) -> set[bytes]:
        made = self.__dict__.setdefault("_windows", {})
        if item not in made:
            ids = self.numbered[item].astype(np.int32)
            made[item] = {ids[s:s + self.min_words].tobytes() for s in range(len(ids) - self.min_words + 1)}
        return made[item]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_windows"}

    def leaks(self, texts: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(position of the text, item id) of all leaks in texts cut into words; a pair may come again from another piece of the item."""
        known = self.vocabulary.get
        numbers = [np.fromiter((known(w, -1) for w in ws), np.int64, len(ws)) for ws in texts]
        if not len(self.grams) or not numbers:
            return
        sizes = np.array([len(x) for x in numbers])
        first = np.cumsum(sizes) - sizes
        flat = np.concatenate(numbers)
        if len(flat) < self.min_words:
            return
        # occurrences of index terms: three known words of one document
        key = _gram_keys(flat)
        ok = (flat[:-2] >= 0) & (flat[1:-1] >= 0) & (flat[2:] >= 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ok &= owner[:-2] == owner[2:]
        at = np.flatnonzero(ok)
        term = np.searchsorted(self.grams, key[at])
        term[term == len(self.grams)] = 0
        here = self.grams[term] == key[at]
        at, term = at[here], term[here]
        if not len(at):
            return
        # each occurrence takes part in one or two passages: words step*k to step*k + width
        width, step = 2 * self.min_words, self.min_words + 1
        inner = at - first[owner[at]]
        base = np.cumsum(sizes // step + 1) - (sizes // step + 1)
        k = inner // step
        passage = base[owner[at]] + k
        again = (k > 0) & (inner - step * (k - 1) <= width - 3)
        n_terms = len(self.grams)
        pairs = np.unique(np.concatenate([passage, passage[again] - 1]) * n_terms + np.concatenate([term, term[again]]))
        passage, term = pairs // n_terms, pairs % n_terms
        # the bound of a block is the sum of its maxima; blocks that hold none of a passage's terms are never touched
        which, where = _spans(self.block_at, term)
        n_blocks = len(self.least)
        met, slot = np.unique(passage[which] * n_blocks + self.blocks[where], return_inverse=True)
        bound = np.bincount(slot, self.block_max[where])
        open_ = met[bound >= self.least[met % n_blocks] * (1 - _SLACK)]
        if not len(open_):
            return
        # in the blocks left, the items' own scores
        which, where = _spans(self.item_at, term)
        item = self.items[where]
        inside = np.isin(passage[which] * n_blocks + item // BLOCK, open_)
        n_items = len(self.item_ids)
        met, slot = np.unique(passage[which[inside]] * n_items + item[inside], return_inverse=True)
        score = np.bincount(slot, self.weights[where[inside]])
        seen: set[tuple[int, int]] = set()
        last, own = -1, []
        for p, i in zip(*(x.tolist() for x in np.divmod(met[score >= self.threshold[met % n_items]], n_items))):
            d = int(np.searchsorted(base, p, "right") - 1)
            if (d, i) in seen:
                continue
            if p != last:
                s = int(first[d] + step * (p - base[d]))
                ids = flat[s:min(s + width, int(first[d] + sizes[d]))].astype(np.int32)
                last, own = p, [ids[x:x + self.min_words].tobytes() for x in range(len(ids) - self.min_words + 1)]
            if not self._window_set(i).isdisjoint(own):
                seen.add((d, i))
                yield d, self.item_ids[i]


def _spans(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term occurrence all places of its postings: (number of the occurrence, place)."""
    size = at[term + 1] - at[term]
    which = np.repeat(np.arange(len(term)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[term], size)


def _gram_keys(ids: np.ndarray) -> np.ndarray:
    """Key of the three words that begin at each position (meaningless where a word is unknown)."""
    if len(ids) < 3:
        return np.zeros(0, np.int64)
    return (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:]


#: Characters of texts asked at once, and of a stretch of documents that all shards are asked for in turn; a longer text is still handled whole.
_GROUP_CHARS, _STRETCH_CHARS = 1 << 19, 1 << 24


def _parcels(sized: Iterator[tuple[int, object]], most: int) -> Iterator[list]:
    """Consecutive values in parcels: a parcel ends when its sizes reach ``most``."""
    held, size = [], 0
    for n, value in sized:
        held.append(value)
        size += n
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def item_pieces(words_of: list[str], min_words: int, piece_words: int) -> list[list[str]]:
    """The words of an item in pieces of at most ``piece_words``; every run of ``min_words`` lies whole in one. Short items give none."""
    if len(words_of) < min_words:
        return []
    step = piece_words - min_words + 1
    return [words_of[s:s + piece_words] for s in range(0, max(1, len(words_of) - min_words + 1), step)]


def _shards(items: DataFrame, item_key: str, item_text: str, min_words: int, shard_words: int, piece_words: int) -> DataFrame:
    """(shard): pickled indices, each of at most ``shard_words`` words (but one piece at least), built where the items are read."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple[int, tuple[int, list[str]]]]:
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for piece in item_pieces(words(t), min_words, piece_words):
                        yield len(piece), (i, piece)

        for some in _parcels(every(), shard_words - piece_words):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ItemIndex.build(some, min_words))], pa.binary())], ["shard"])

    wanted = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    return wanted.mapInArrow(build, "shard binary")


def leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS,
    shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """(``key``, ``item_key``): the documents that hold ``min_words`` consecutive words of an item, with the items.

    Whole texts are read on both sides. Null, empty and short texts are no case; repeated
    documents each give their own rows, items with equal texts each come out. Without items the
    result is empty. Other columns are not read.
    """
    spark = documents.sparkSession
    # one index a file: the driver takes them one partition of files at a time and hands each on
    made = Scratch(spark, "leaks").cut(_shards(items, item_key, item_text, min_words, shard_words, piece_words), "shards", maxRecordsPerFile=1)
    held = [spark.sparkContext.broadcast(bytes(row.shard)) for row in made.toLocalIterator()]
    key_type = documents.schema[key].dataType.simpleString()
    chosen = documents.select(documents[key].alias("key"), documents[text].cast("string").alias("text")).where("text is not null")
    stretch = _STRETCH_CHARS if len(held) > KEPT else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, ItemIndex] = {}

        def shard(n: int) -> ItemIndex:
            if n not in kept:
                if len(kept) == KEPT:
                    kept.clear()
                kept[n] = pickle.loads(held[n].value)
                vars(held[n]).pop("_value", None)  # the worker has it on disk
            return kept[n]

        sized = ((sum(map(len, filter(None, b.column(1).to_pylist()))), b) for b in batches)
        for parcel in _parcels(sized, stretch):
            keys = pa.concat_arrays([b.column(0) for b in parcel])
            texts = [t for b in parcel for t in b.column(1).to_pylist()]
            found: set[tuple[int, int]] = set()
            cut = list(_parcels(((len(t), (i, words(t))) for i, t in enumerate(texts)), _GROUP_CHARS))
            for n in range(len(held)):
                index = shard(n)
                for group in cut:
                    found.update((group[d][0], i) for d, i in index.leaks([w for _, w in group]))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([d for d, _ in rows], pa.int64())), pa.array([i for _, i in rows], pa.int64())], ["key", "item"])

    out = chosen.mapInArrow(run, f"key {key_type}, item bigint")
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key))
