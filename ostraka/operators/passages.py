"""What spans are told by independent passages, without a table of windows.

The windows of ``witness`` are many more than what is asked of them, and written or shuffled they
take many times the space of the texts. Lines are therefore written once, their tokens as hashes,
and each task takes one bucket of anchor pairs out of all lines: every window of a pair, of all
families, is in one bucket, so supports and standings of its spans are told there and only what
a query folds of them leaves the task. Buckets go by the two tokens next to the middle, so a
span is in one bucket for all lengths of anchors.

Pairs are told apart by 96 bits of scope and anchors, middles within a pair by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .witness import MARK, MAX_MIDDLE

#: Tokens a bucket stands for, some eight windows each, and lines read at a time: sizes of work, not limits of the result.
TOKENS, BATCH = 200_000, 32_768
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(29))


def _read(root: str, name: str, *columns: str) -> pa.Table:
    where, path = fs.FileSystem.from_uri(f"{root}/{name}")
    return pq.read_table(path, columns=list(columns), filesystem=where).combine_chunks()


def _batches(root: str) -> Iterator[pa.RecordBatch]:
    where, path = fs.FileSystem.from_uri(f"{root}/lines")
    for info in sorted(where.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(BATCH)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


class _Bucket:
    """The windows of one bucket: tokens next to them on both sides, middles and where they are."""

    def __init__(self, root: str, b: int, n_buckets: int, most: int, anchors: list[int], keep: bool):
        least, widest = min(anchors), max(anchors)
        units: dict = {}
        self.root, read = root, 0
        parts: list[list[np.ndarray]] = []
        mask, b16 = np.uint16(n_buckets - 1), np.uint16(b)
        for batch in _batches(root):
            lists = batch.column("h")
            sizes = np.diff(lists.offsets.to_numpy())
            th = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            end = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            rem = np.minimum(np.repeat(end, sizes) - np.arange(len(th)), 60_000).astype(np.uint16)
            left, right = th.astype(np.uint16), (th >> np.uint64(20)).astype(np.uint16)
            found = []
            for n in range(min(most, len(th) - 2) + 1):
                at = np.flatnonzero((((left[:len(th) - 1 - n] ^ right[1 + n:]) & mask) == b16) & (rem[:len(th) - 1 - n] >= n + 1 + least))
                found.append(at[at - (end - sizes)[row[at]] >= least - 1])
            if not found:
                continue
            at, length = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int8), [len(x) for x in found])
            of = row[at]
            start = (at - (end - sizes)[of]).astype(np.int32)  # of the token before the middle
            room = np.minimum(np.minimum(start, rem[at].astype(np.int32) - length - 2) + 1, widest).astype(np.int8)
            middle = np.full(len(at), _B)
            s = 0
            for n, x in enumerate(found):
                h = np.full(len(x), _B)
                for k in range(n):
                    h = _mix((h + th[x + 1 + k]) * _A)
                middle[s:s + len(x)] = h
                s += len(x)
            scope = batch.column("scope").to_numpy().view(np.uint64)[of]
            keys, checks = [], []
            key, check = _mix(scope + _A), _mix(scope + _B)
            for a in range(widest):  # anchors grow outwards from the middle
                fit = room > a
                x, y = th[np.where(fit, at - a, at)], th[np.where(fit, at + length + 1 + a, at)]
                key = _mix((_mix((key + x) * _A) + y) * _B)
                check = _mix((_mix((check ^ x) * _C) ^ y) * _A)
                keys.append(key)
                checks.append(check.astype(np.uint32))
            said = batch.column("unit").dictionary_encode()
            code = np.array([units.setdefault(u, len(units)) for u in [*said.dictionary.to_pylist(), *[None] * (said.null_count > 0)]], np.int32)
            known = said.indices.fill_null(len(code) - 1).to_numpy()
            columns = [*keys, *checks, middle, length, room, batch.column("family").to_numpy()[of], code[known[of]]]
            if keep:
                columns += [batch.column("doc_id").to_numpy()[of], batch.column("line").to_numpy()[of], start + 1, at + read]
            read += len(th)
            parts.append(columns)
        names = [f"k{a}" for a in range(widest)] + [f"c{a}" for a in range(widest)] + ["middle", "length", "room", "family", "unit"] + (["doc_id", "line", "start", "at"] if keep else [])
        self.units = list(units)
        self.all = {}
        for i, name in enumerate(names):
            self.all[name] = np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if name[0] == "k" or name == "middle" else np.int64)
            for p in parts:
                p[i] = None

    def pairs(self, a: int, masks: list[int]) -> Pairs:
        return Pairs(self, a, masks)

    def tokens(self, windows: np.ndarray) -> np.ndarray:
        """(window, place): hashes of the middles' tokens, 0 behind them; read again, as few windows are asked for them."""
        at, length = self.all["at"][windows], self.all["length"][windows]
        out = np.zeros((len(at), int(length.max(initial=0))), np.uint64)
        order, read = np.argsort(at, kind="stable"), 0
        for batch in _batches(self.root):
            th = batch.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            x, y = np.searchsorted(at, (read, read + len(th)), sorter=order)
            here = order[x:y]
            for k in range(out.shape[1]):
                w = here[length[here] > k]
                out[w, k] = th[at[w] + 1 + k - read]
            read += len(th)
        return out


class Pairs:
    """The windows of a bucket with ``a`` anchors a side, in pairs that enclose a span and that two families have; votes, middles and views.

    A vote is a middle of a family, a view what a family sees of a pair. Each is numbered; ``of`` names
    give the number of one thing in the other.
    """

    def __init__(self, bucket: _Bucket, a: int, masks: list[int]):
        self.bucket, self.a = bucket, a
        every, self.asked_lengths = bucket.all, np.array(masks)
        own = np.flatnonzero(every["room"] >= a)
        key = every[f"k{a - 1}"][own]
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        check = every[f"c{a - 1}"][own]
        new = _runs(key)
        if (_runs(key, check) & ~new).any():  # two pairs share 64 bits
            order = np.lexsort((check, key))
            own, key, check = own[order], key[order], check[order]
            new = _runs(key, check)
        if len(own):
            first = np.flatnonzero(new)
            family = every["family"][own]
            good = np.minimum.reduceat(family, first) != np.maximum.reduceat(family, first)
            good &= np.logical_or.reduceat(np.isin(every["length"][own], self.asked_lengths), first)
            pair = np.cumsum(new) - 1
            stay = good[pair]
            own, pair = own[stay], pair[stay]
            del key, check, family, stay, new, order
        else:
            pair = np.zeros(0, np.int64)
        family, middle = every["family"][own], every["middle"][own]
        order = np.lexsort((family, middle, pair))
        self.windows, pair, family, middle = own[order], pair[order], family[order], middle[order]
        new_middle = _runs(pair, middle)
        new_vote = new_middle | _runs(family)
        self.vote = np.cumsum(new_vote) - 1  # of each window
        at, self.middle_first = np.flatnonzero(new_vote), self.windows[new_middle]
        self.middle = (np.cumsum(new_middle) - 1)[at]  # of each vote
        new_pair = _runs(pair)
        self.pair = (np.cumsum(new_pair) - 1)[np.flatnonzero(new_middle)]  # of each middle
        self.pair_of_window = np.cumsum(new_pair) - 1
        self.support = np.bincount(self.middle, minlength=len(self.middle_first))
        self.length = every["length"][self.middle_first].astype(np.int64)
        self.n_pairs = int(new_pair.sum())
        self.family = np.unique(family[at], return_inverse=True)[1].astype(np.int64)
        voting = self.pair[self.middle] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((self.family, voting))
        new = _runs(voting[order], self.family[order])
        self.view = np.empty(len(at), np.int64)  # of each vote
        self.view[order] = np.cumsum(new) - 1
        self.view_pair, self.view_family = voting[order][new], self.family[order][new]
        self.asked = np.isin(self.length, self.asked_lengths)[self.middle] if len(at) else np.zeros(0, bool)  # of each vote
        self.own = np.bincount(self.view, minlength=len(self.view_pair))
        alone = np.bincount(self.view[self.support[self.middle] == 1], minlength=len(self.view_pair))
        self.alternatives = np.bincount(self.pair, minlength=self.n_pairs)[self.view_pair] - alone
        self.total = np.bincount(self.pair, self.support, self.n_pairs).astype(np.int64)[self.view_pair] - self.own
        self.spans = np.flatnonzero(self.asked[self.vote] & (self.alternatives[self.view[self.vote]] > 0)) if len(at) else np.zeros(0, np.int64)  # windows that are spans with a proposal

    def __getitem__(self, name: str) -> np.ndarray:
        """A column of the windows that are spans with a proposal."""
        return self.bucket.all[name][self.windows[self.spans]]

    @property
    def span_view(self) -> np.ndarray:
        return self.view[self.vote[self.spans]]

    @property
    def span_middle(self) -> np.ndarray:
        return self.middle[self.vote[self.spans]]

    def spelling(self, root: str) -> np.ndarray:
        """The place of each middle's spelling, tokens joined by ``MARK``, among those of all middles."""
        words = _read(root, "words", "h", "last", "inner")
        h = words["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        tokens = self.bucket.tokens(self.middle_first)
        codes = np.full(tokens.shape, -1)
        for k in range(tokens.shape[1]):
            has = self.length > k
            at = order[np.searchsorted(h, tokens[has, k], sorter=order)]
            codes[has, k] = np.where(self.length[has] == k + 1, words["last"].to_numpy()[at], words["inner"].to_numpy()[at])
        place = np.empty(len(codes), np.int64)
        place[np.lexsort([*codes.T[::-1], self.length * 0] if codes.shape[1] == 0 else codes.T[::-1])] = np.arange(len(codes))
        return place

    def first(self, depth: int, place: np.ndarray | None = None, beyond: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(view, rank): middle and support of the first ``depth`` proposals of each view of a span that has more than ``beyond``, -1 and 0 where there are fewer.

        They go by support, then by ``place``; without it, ties are in any order. The first d are among the first d plus the own ones of the pair.
        """
        place = np.zeros(len(self.support), np.int64) if place is None else place
        order = np.lexsort((place, -self.support, self.pair))
        begin = np.searchsorted(self.pair, np.arange(self.n_pairs + 1))  # middles are sorted by pair
        who, what = np.full((len(self.view_pair), depth), -1), np.zeros((len(self.view_pair), depth), np.int64)
        voted = self.middle * (len(self.view_family) + 1) + self.family  # sorted, as votes are
        views = np.unique(self.view[self.asked])
        views = views[self.alternatives[views] > beyond]
        many = np.minimum(begin[self.view_pair[views] + 1] - begin[self.view_pair[views]], depth + self.own[views])
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + 1_000_000, 1_000_000)) if len(views) else []
        for x, y in zip(cuts[:-1], cuts[1:]):
            view, n = views[x:y], many[x:y]
            if not len(view):
                continue
            of = np.repeat(view, n)
            rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            m = order[begin[self.view_pair[of]] + rank]
            ask = m * (len(self.view_family) + 1) + self.view_family[of]
            at = np.minimum(np.searchsorted(voted, ask), len(voted) - 1)
            s = self.support[m] - (voted[at] == ask)
            stay = s > 0
            of, m, s = of[stay], m[stay], s[stay]
            best = np.lexsort((place[m], -s, of))
            of, m, s = of[best], m[best], s[best]
            begins = np.flatnonzero(_runs(of))
            rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
            shown = rank < depth
            who[of[shown], rank[shown]], what[of[shown], rank[shown]] = m[shown], s[shown]
        return who, what

    def tied(self, supports: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(support, size) of what each view is shown to ``depth`` with all that are tied with the last of them."""
        more = self.alternatives > depth
        last = np.where(more, supports[:, depth - 1], 1)
        top = int(self.support.max(initial=0)) + 2
        level = np.sort(self.pair * top + self.support)
        above = np.searchsorted(level, (self.view_pair + 1) * top) - np.searchsorted(level, self.view_pair * top + last)
        own = np.sort(self.view * top + self.support[self.middle])
        same = self.view_at(own, top, last)
        return last, np.where(more, above - same, self.alternatives)

    def view_at(self, own: np.ndarray, top: int, level: np.ndarray) -> np.ndarray:
        ask = np.arange(len(self.view_pair)) * top + level
        return np.searchsorted(own, ask, "right") - np.searchsorted(own, ask)


def counts(columns: dict[str, np.ndarray]) -> pa.Table:
    """The distinct rows of the columns with their number, c."""
    names = list(columns)
    rows = [np.asarray(x).astype(np.int64) for x in columns.values()]
    order = np.lexsort(rows[::-1])
    rows = [x[order] for x in rows]
    first = np.flatnonzero(_runs(*rows))
    return pa.table([*(x[first] for x in rows), np.diff(np.append(first, len(order)))], [*names, "c"])


class Passages:
    """``lines`` (doc_id, line, family, tokens, scope and unit), written for the buckets; ``ordered`` if spellings of middles are compared."""

    def __init__(self, lines: DataFrame, scope: str, unit: str, ordered: bool = False):
        self.scratch, self.ordered = Scratch(lines.sparkSession, "passages"), ordered
        coded = lines.select("doc_id", F.col("line").cast("int").alias("line"), F.xxhash64(F.lit(1), scope).alias("scope"), F.col(unit).alias("unit"), F.col("family").cast("long").alias("family"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
        written = self.scratch.cut(coded, "lines")
        if ordered:  # spellings are compared with what stands behind a token: the mark, or nothing
            words = lines.select(F.explode("tokens").alias("t")).distinct()
            forms = words.select("t", F.explode(F.array(F.lit(""), F.lit(MARK))).alias("x")).orderBy(F.concat("t", "x")).select("t", "x", F.monotonically_increasing_id().alias("place"))
            both = forms.groupBy("t").agg(F.max(F.when(F.col("x") == "", F.col("place"))).alias("last"), F.max(F.when(F.col("x") != "", F.col("place"))).alias("inner"))
            self.scratch.cut(both.select("t", F.xxhash64("t").alias("h"), "last", "inner"), "words")
        self.lines = written.withColumnRenamed("h", "tokens")  # for counts of lines and tokens: scopes and tokens are hashes
        tokens = written.agg(F.sum(F.size("h"))).first()[0] or 0
        self.buckets = 1 << max(3, min(16, (tokens // TOKENS).bit_length()))

    def told(self, anchors: list[int], masks: list[int], fold: Callable[[_Bucket, str], pa.Table], schema: str, max_middle: int = MAX_MIDDLE, keep: bool = False) -> DataFrame:
        """What ``fold`` makes of each bucket; ``keep`` if it needs where windows are, or their tokens."""
        root, n = self.scratch.root, self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    yield from fold(_Bucket(root, b, n, max_middle, anchors, keep), root).combine_chunks().to_batches()

        return self.scratch.spark.range(0, n, 1, n).mapInArrow(run, schema)


def named(codes: pa.ChunkedArray, bucket: _Bucket) -> pa.Array:
    return pa.array(bucket.units, pa.string()).take(codes.combine_chunks())


def census(passages: Passages, anchors: list[int], masks: list[int], max_middle: int = MAX_MIDDLE) -> DataFrame:
    """(anchors, mask, unit, supported, exact, variant_only, ambiguous): counts of spans."""

    def fold(bucket: _Bucket, root: str) -> pa.Table:
        out = []
        for a in anchors:
            p = bucket.pairs(a, masks)
            n, gold = p.alternatives[p.span_view], p.support[p.span_middle] > 1
            t = counts({"mask": p["length"], "unit": p["unit"], "exact": gold, "ambiguous": n > 1})
            out.append(t.set_column(1, "unit", named(t["unit"], bucket)).add_column(0, "anchors", pa.array(np.full(t.num_rows, a))))
        return pa.concat_tables(out)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("c")).otherwise(0))

    rows = passages.told(anchors, masks, fold, "anchors long, mask long, unit string, exact long, ambiguous long, c long", max_middle)
    exact = F.col("exact") == 1
    return rows.groupBy(F.col("anchors").cast("int").alias("anchors"), F.col("mask").cast("int").alias("mask"), "unit").agg(
        F.sum("c").alias("supported"), total(exact).alias("exact"), total(~exact).alias("variant_only"), total(F.col("ambiguous") == 1).alias("ambiguous"))


def horizon(passages: Passages, anchors: list[int], masks: list[int], depth: int) -> DataFrame:
    """(mask, a, hit, expanded, c): spans told by the longest anchors that have any proposal, shown tie-completely to ``depth``."""

    def fold(bucket: _Bucket, root: str) -> pa.Table:
        out, done = [], np.zeros(len(bucket.all["length"]), bool)
        for a in sorted(anchors, reverse=True):
            p = bucket.pairs(a, masks)
            last, size = p.tied(p.first(depth, beyond=depth)[1], depth)
            gold, view = p.support[p.span_middle] - 1, p.span_view
            left = ~done[p.windows[p.spans]]
            t = counts({k: v[left] for k, v in {"mask": p["length"], "hit": (gold > 0) & (gold >= last[view]), "expanded": size[view] > depth}.items()})
            out.append(t.add_column(1, "a", pa.array(np.full(t.num_rows, a))))
            done[p.windows[p.spans]] = True
        return pa.concat_tables(out)

    return passages.told(anchors, masks, fold, "mask long, a long, hit long, expanded long, c long")


def candidate_ranks(passages: Passages, anchors: int, masks: list[int], depth: int) -> DataFrame:
    """(n_alt, gold_rank, gold_support, top, top_len, c): spans with any proposal; the place of the gold reading is null beyond ``depth``."""

    def fold(bucket: _Bucket, root: str) -> pa.Table:
        p = bucket.pairs(anchors, masks)
        who, what = p.first(depth, p.spelling(root))
        view, middle = p.span_view, p.span_middle
        at = who[view] == middle[:, None]
        rank = np.where(at.any(1), at.argmax(1) + 1, 0)
        return counts({"n_alt": p.alternatives[view], "gold_rank": rank, "gold_support": p.support[middle] - 1, "top": what[view, 0], "top_len": p.length[who[view, 0]]})

    rows = passages.told([anchors], masks, fold, "n_alt long, gold_rank long, gold_support long, top long, top_len long, c long", keep=True)
    return rows.withColumn("gold_rank", F.when(F.col("gold_rank") > 0, F.col("gold_rank")))


def disagreements(passages: Passages, anchors: int, mask: int) -> DataFrame:
    """(middles, families, units, again, absent, c): spans whose first proposal is not the gold reading, by whether there are several middles,
    several families for the first, several units with the anchors, the anchors again in the document, and no family for the gold reading."""

    def fold(bucket: _Bucket, root: str) -> pa.Table:
        p = bucket.pairs(anchors, [mask])
        who, what = p.first(1, p.spelling(root))
        view, middle = p.span_view, p.span_middle
        pair, unit = p.pair_of_window, bucket.all["unit"][p.windows]
        order = np.lexsort((unit, pair))
        units = np.bincount(pair[order][_runs(pair[order], unit[order])], minlength=p.n_pairs)
        doc, spans = bucket.all["doc_id"][p.windows], bucket.all["length"][p.windows] == mask
        order = np.lexsort((spans, doc, pair))
        run = np.cumsum(_runs(pair[order], doc[order])) - 1
        times = np.empty(len(pair), np.int64)
        times[order] = np.bincount(run, spans[order])[run] if len(run) else 0
        wrong = who[view, 0] != middle
        t = {"middles": p.alternatives[view] > 1, "families": what[view, 0] > 1, "units": units[pair[p.spans]] > 1, "again": times[p.spans] > 1, "absent": p.support[middle] == 1}
        return counts({k: v[wrong] for k, v in t.items()})

    return passages.told([anchors], [mask], fold, "middles long, families long, units long, again long, absent long, c long", keep=True)


def firsts_of_units(passages: Passages, anchors: int, mask: int, rule: tuple[int, int, float, int], depth: int, each: int) -> DataFrame:
    """(doc_id, line, start, unit, n_alt, total, unique_top, accepted, top_exact, first): the first ``each`` spans with a proposal of each unit and kind, at least.

    ``rule`` is the least support, margin and dominance and the most alternatives. ``first`` lists (m, support), ``m`` spelled.
    """

    def fold(bucket: _Bucket, root: str) -> pa.Table:
        p = bucket.pairs(anchors, [mask])
        who, what = p.first(max(depth, 2), p.spelling(root))
        view, middle = p.span_view, p.span_middle
        s, m, d, a = rule
        n, total, top, margin = p.alternatives[view], p.total[view], what[view, 0], what[view, 0] - what[view, 1]
        unique = margin > 0
        accepted = unique & (top >= s) & (margin >= m) & (top / total >= d) & (n <= a)
        exact = unique & (p.support[middle] - 1 == top)
        unit, doc, line, start = (p[x] for x in ("unit", "doc_id", "line", "start"))
        order = np.lexsort((start, line, doc, unit, exact, accepted, unique))
        begins = np.flatnonzero(_runs(*(x[order] for x in (unit, exact, accepted, unique))))
        nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        kept = order[nth < each]
        shown = who[view[kept], :depth]
        words = _read(root, "words", "h", "t")
        told = np.unique(shown[shown >= 0])
        tokens, number = bucket.tokens(p.middle_first[told]), dict(zip(told.tolist(), range(len(told))))
        wanted = np.unique(tokens.ravel())
        at = np.flatnonzero(np.isin(words["h"].to_numpy().view(np.uint64), wanted))
        spelled = dict(zip(words["h"].to_numpy().view(np.uint64)[at].tolist(), words["t"].take(pa.array(at)).to_pylist()))

        def reading(i: int) -> str:
            return MARK.join(spelled[t] for t in tokens[number[i]].tolist()[:p.length[i]])

        first = [[{"m": reading(i), "support": int(x)} for i, x in zip(row, sup) if i >= 0] for row, sup in zip(shown.tolist(), what[view[kept], :depth].tolist())]
        t = pa.table([doc[kept], line[kept], start[kept], named(pa.chunked_array([unit[kept]]), bucket), *(pa.array(x[kept]) for x in (n, total, unique, accepted, exact)), pa.array(first, pa.list_(pa.struct([("m", pa.string()), ("support", pa.int64())])))],
                     ["doc_id", "line", "start", "unit", "n_alt", "total", "unique_top", "accepted", "top_exact", "first"])
        return t

    return passages.told([anchors], [mask], fold, "doc_id long, line int, start int, unit string, n_alt long, total long, unique_top boolean, accepted boolean, top_exact boolean, first array<struct<m:string,support:bigint>>", keep=True)
