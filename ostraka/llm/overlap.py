"""Same or near-same records across splits, by similarity-hash fingerprints joined in code blocks.

Texts are normalised to token lists. Equal lists form one class, whatever number of records
holds it. The elements of a class are its tokens with their occurrence (the second "ki" is another
element than the first), but for worn signs and numbers, which all texts share. Its fingerprint has
``LANES`` lanes of 8 bits, each the low bits of the least element under a hash of its own (b-bit
minwise hashing): a lane of two classes agrees with the share of elements they have in common
(Jaccard), or by chance with 1/256. ``SEGMENT`` lanes side by side are a code block of 48 bits;
classes of the training split and of the evaluation splits that agree in a block meet, the meeting
is kept if the fingerprints' lowest bits lie within the Hamming radius, and what is left, almost all
of it true, is compared token by token.

Why these widths: replacing a fifth of the tokens (the limit) leaves a Jaccard of 0.8 / 1.2 = 0.667, a
block agrees with 0.669^6 = 0.090 and one of 48 does with 0.989; at a tenth of the tokens 0.9999999.
Unrelated lists, of whose elements a twentieth is common, agree in a block with 0.054^6 = 2.4e-8,
so chance meetings stay far below the number of rows joined up to some 1e7 evaluation classes. The
radius, 90 of 256 bits, is that of a Jaccard of one half plus four standard deviations: less is left
only where all edits hit the telling tokens of a text mostly worn.

That is a probability. ``exact=True`` finds candidates without one: a list within the limit of another
has ``pieces`` of three tokens at least, one more than there can be edits, one of which stands in the
other list, shifted by no more than the edits. It meets on every run of three tokens and costs more.

Pairs of classes with the membership of classes are the scalable result (``class_links``); pairs of
records are their expansion, and counts of pairs are taken from the classes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import WHITE, trimmed
from ..storage import Scratch

LANES, SEGMENT = 288, 6
BLOCKS = LANES // SEGMENT
SKETCH, RADIUS = 4, 90  # 64-bit words of lowest bits, and how many of these bits may differ
PIECE = 3
MIN_TOKENS, EDIT_SHARE = 12, 0.2
#: Characters deleted before comparison, and tokens that do not count.
_DELETED = str.maketrans("", "", "[]⸢⸣?!*#")
_WORN = frozenset(("x", "<num>"))


def normal_tokens(text: str) -> list[str]:
    """Tokens after composing (NFC), lower-casing and deleting the editorial characters."""
    return unicodedata.normalize("NFC", text).lower().translate(_DELETED).split()


def _elements(tokens: list[str]) -> list[tuple[str, int]]:
    """Telling tokens, each with the number of its occurrence."""
    seen: dict[str, int] = {}
    out = []
    for t in tokens:
        if t not in _WORN:
            seen[t] = k = seen.get(t, -1) + 1
            out.append((t, k))
    return out


def _lane_constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, LANES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, LANES, np.uint64)


_TIMES, _PLUS = _lane_constants()


def fingerprints(lists: list[list[str]]) -> np.ndarray:
    """(lists, LANES) of bytes: the fingerprint of each token list, of which none may be all worn."""
    import xxhash

    number: dict[tuple[str, int], int] = {}
    parts = [[number.setdefault(e, len(number)) for e in _elements(ts)] for ts in lists]
    seeds = np.array([xxhash.xxh3_64_intdigest(t, k) for t, k in number], np.uint64)
    out = np.empty((len(lists), LANES), np.uint8)
    for a in range(0, len(lists), 128):
        some = parts[a:a + 128]
        flat, starts = seeds[np.concatenate([np.array(p, np.int64) for p in some])], np.cumsum([0] + [len(p) for p in some[:-1]])
        with np.errstate(over="ignore"):
            lanes = flat[:, None] * _TIMES + _PLUS
        least = np.minimum.reduceat((lanes >> np.uint64(32)).astype(np.uint32), starts, axis=0)
        out[a:a + 128] = least & np.uint32(0xFF)
    return out


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """(lists, BLOCKS) codes of 48 bits, each with its block number in the high bits."""
    weights = np.int64(1) << (8 * np.arange(SEGMENT, dtype=np.int64))
    return prints.reshape(len(prints), BLOCKS, SEGMENT).astype(np.int64) @ weights + (np.arange(BLOCKS, dtype=np.int64) << (8 * SEGMENT))[None, :]


def sketches(prints: np.ndarray) -> np.ndarray:
    """(lists, SKETCH) words of the lowest bit of the first 64 * SKETCH lanes."""
    return np.packbits(prints[:, :64 * SKETCH] & 1, axis=1).view(np.int64)


def within_edits(a: list[str], b: list[str], most: int) -> bool:
    """Whether ``a`` can be turned into ``b`` by at most ``most`` insertions, deletions and replacements of tokens."""
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return max(len(a), len(b)) <= most
    # bit-parallel columns: one big integer holds a column's vertical differences
    m = len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    pv, mv, score = full, 0, m
    for t in b:
        eq = where.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score <= most


def _prepared(rows: DataFrame) -> DataFrame:
    """(tablet, side, text): normalised texts with enough tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lists = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                ts = normal_tokens(t)
                if sum(x not in _WORN for x in ts) >= MIN_TOKENS:
                    keep.append(i)
                    lists.append(" ".join(ts))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lists, pa.string())], ["tablet", "side", "text"])

    return rows.mapInArrow(run, "tablet string, side string, text string")


def _fingerprinted(classes: DataFrame) -> DataFrame:
    """(cid, sides, text, codes, f0, ...) of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                prints = fingerprints([t.split(" ") for t in part.column(2).to_pylist()])
                words = sketches(prints)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * BLOCKS, pa.int32()), pa.array(blocks_of(prints).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, codes, *[pa.array(words[:, i].copy()) for i in range(SKETCH)]], ["cid", "sides", "text", "codes", *[f"f{i}" for i in range(SKETCH)]])

    words = ", ".join(f"f{i} bigint" for i in range(SKETCH))
    return classes.select("cid", "sides", "text").mapInArrow(run, f"cid bigint, sides int, text string, codes array<bigint>, {words}")


def _verified(pairs: DataFrame, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i).to_pylist() for i in (2, 3))
            good = []
            for x, y in zip(left, right):
                a, b = x.split(" "), y.split(" ")
                good.append(within_edits(a, b, int(share * max(len(a), len(b)) + 1e-9)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["ca", "cb"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "ca bigint, cb bigint")


def tablet_labels(splits: DataFrame) -> DataFrame:
    """(doc_id, label): tablets with exactly one distinct label; null labels say nothing."""
    known = splits.select("doc_id", F.lower(trimmed(F.col("main_split"))).alias("label")).where("doc_id is not null and label is not null").distinct()
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id", "label")


def _near(prints: DataFrame) -> DataFrame:
    """(ca, cb): classes of train and of evaluation that agree in a code block, within the Hamming radius."""
    block = prints.select("cid", "sides", F.explode("codes").alias("code"))
    train = block.where("sides in (1, 3)").select("code", F.col("cid").alias("ca"))
    evals = block.where("sides in (2, 3)").select("code", F.col("cid").alias("cb"))
    # codes only on the rows that are shuffled many times over; bits and texts once a pair
    met = train.join(evals, "code").where("ca <> cb").select("ca", "cb").distinct()
    bits = [f"f{i}" for i in range(SKETCH)]
    left = prints.select(F.col("cid").alias("ca"), F.col("text").alias("ta"), *[F.col(f).alias(f"a{f}") for f in bits])
    right = prints.select(F.col("cid").alias("cb"), F.col("text").alias("tb"), *[F.col(f).alias(f"b{f}") for f in bits])
    apart = " + ".join(f"bit_count(a{f} ^ b{f})" for f in bits)
    return met.join(left, "ca").join(right, "cb").where(f"{apart} <= {RADIUS}").select("ca", "cb", "ta", "tb")


def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """(start, length) of the disjoint pieces of a list of ``n`` tokens, one more than there can be edits.

    The other list has at most n / (1 - share) tokens, so there are at most share * n / (1 - share) edits.
    """
    k = int(share * n / (1 - share) + 1e-9) + 1
    return [(n * i // k, n * (i + 1) // k - n * i // k) for i in range(k)]


def _surely_near(prints: DataFrame, share: float) -> DataFrame:
    """``_near`` without a probability: some piece of the evaluation list stands in the training list, shifted by no more than the edits."""
    width = max(1, int((1 - share) / share + 1e-9) - 1)  # the least length of a piece

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            cid, side, at, code, n = [], [], [], [], []
            for c, sides, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ts = text.split(" ")
                for s, starts in ((1, range(len(ts) - width + 1)), (2, [p for p, _ in pieces(len(ts), share)])):
                    if sides & s:
                        for p in starts:
                            cid.append(c)
                            side.append(s)
                            at.append(p)
                            n.append(len(ts))
                            code.append(xxhash.xxh3_64_intdigest(" ".join(ts[p:p + width])) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid, pa.int64()), pa.array(side, pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(code, pa.int64())], ["cid", "side", "at", "n", "code"])

    runs = prints.select("cid", "sides", "text").mapInArrow(cut, "cid bigint, side int, at int, n int, code bigint")
    a = runs.where("side = 1").select("code", F.col("cid").alias("ca"), F.col("at").alias("pa"), F.col("n").alias("na"))
    b = runs.where("side = 2").select("code", F.col("cid").alias("cb"), F.col("at").alias("pb"), F.col("n").alias("nb"))
    most = F.floor(F.greatest("na", "nb") * share + 1e-9)
    met = a.join(b, "code").where((F.col("ca") != F.col("cb")) & (F.abs(F.col("pa") - F.col("pb")) <= most) & (F.abs(F.col("na") - F.col("nb")) <= most)).select("ca", "cb").distinct()
    return met.join(prints.select(F.col("cid").alias("ca"), F.col("text").alias("ta")), "ca").join(prints.select(F.col("cid").alias("cb"), F.col("text").alias("tb")), "cb").select("ca", "cb", "ta", "tb")


def class_links(failures: DataFrame, splits: DataFrame, share: float = EDIT_SHARE, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ca, cb) and (cid, class_id, tablet, side): links of a training class with an equal or near evaluation class, and who is in a class.

    A class is one normalised text, named by its MD5. A class of both sides is linked with itself. The
    links number what texts there are, however many records hold them.
    """
    scratch = Scratch(failures.sparkSession, "overlap")
    labels = tablet_labels(splits).select(
        "doc_id", F.when(F.col("label") == "train", "train").when(F.col("label").isin("dev", "test"), "eval").alias("side")).where("side is not null")
    rows = failures.where("doc_id is not null and query_rendering is not null").select(
        "doc_id", F.trim(F.regexp_replace("query_rendering", WHITE, " ")).alias("text")).distinct()
    rows = rows.join(labels, "doc_id").select(F.col("doc_id").alias("tablet"), "side", "text")
    member = scratch.cut(_prepared(rows).distinct(), "member")
    sides = member.groupBy("text").agg(
        F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") == "eval").cast("int")).alias("e"))
    classes = scratch.cut(sides.select(F.monotonically_increasing_id().alias("cid"), (F.col("t") + 2 * F.col("e")).alias("sides"), "text"), "classes")
    if exact:
        pairs = _surely_near(classes, share)
    else:
        pairs = _near(scratch.cut(_fingerprinted(classes), "prints"))
    same = classes.where("sides = 3").select(F.col("cid").alias("ca"), F.col("cid").alias("cb"))
    links = scratch.cut(_verified(pairs, share).unionByName(same), "links")
    of = member.join(classes.select("cid", "text"), "text").select("cid", F.md5("text").alias("class_id"), "tablet", "side")
    return links, of


def cross_split_pairs(failures: DataFrame, splits: DataFrame, share: float = EDIT_SHARE, exact: bool = False) -> DataFrame:
    """(train_id, eval_id): tablets of train and of dev or test with an equal or nearly equal rendering.

    Each pair comes out once. Rows with a null doc_id or rendering, tablets with no or several
    labels, and renderings of fewer than 12 tokens that are not worn signs or numbers take no
    part. Near means at most ``share`` of the longer list's tokens inserted, deleted or
    replaced. Empty tables give no rows; other columns are not read.
    """
    links, of = class_links(failures, splits, share, exact)
    left = of.where("side = 'train'").select(F.col("cid").alias("ca"), F.col("tablet").alias("train_id"))
    right = of.where("side = 'eval'").select(F.col("cid").alias("cb"), F.col("tablet").alias("eval_id"))
    return links.join(left, "ca").join(right, "cb").select("train_id", "eval_id").distinct()


def linked_classes(failures: DataFrame, splits: DataFrame, share: float = EDIT_SHARE, exact: bool = False) -> DataFrame:
    """(doc_id, class_id, side, links): each tablet under the class of each of its renderings, with the number of classes of the other side linked to it."""
    links, of = class_links(failures, splits, share, exact)
    ends = links.select(F.explode(F.array(F.struct(F.col("ca").alias("cid"), F.lit("train").alias("side")), F.struct(F.col("cb").alias("cid"), F.lit("eval").alias("side")))).alias("e"))
    counted = ends.groupBy("e.cid", "e.side").agg(F.count(F.lit(1)).alias("links"))
    return of.join(counted, ["cid", "side"], "left").select(F.col("tablet").alias("doc_id"), "class_id", "side", F.coalesce("links", F.lit(0)).alias("links"))


def overlap_report(failures: DataFrame, splits: DataFrame, share: float = EDIT_SHARE, exact: bool = False) -> DataFrame:
    """(eval_split, site, pairs, eval_tablets): cross-split overlaps per evaluation split and site of the evaluation tablet.

    A tablet that stands under several sites counts under each; one without a site under null.

    Pairs are counted, not made: tablets with one class count by class (a text of n training and m
    evaluation tablets is one product), and only tablets with several classes, whose pairs could come
    twice, are told apart by name.
    """
    links, of = class_links(failures, splits, share, exact)
    of = of.select("cid", "tablet", "side")
    held = of.groupBy("side", "tablet").agg(F.count(F.lit(1)).alias("classes"))
    of = of.join(held, ["side", "tablet"])
    train, evals = of.where("side = 'train'"), of.where("side = 'eval'")
    label = tablet_labels(splits).select(F.col("doc_id").alias("tablet"), F.col("label").alias("eval_split"))
    sites = splits.select(F.col("doc_id").alias("tablet"), "site").where("tablet is not null").distinct()
    known = sites.where("site is not null")
    lone = sites.select("tablet").distinct().join(known.select("tablet").distinct(), "tablet", "left_anti").withColumn("site", F.lit(None).cast("string"))
    where = label.join(known.unionByName(lone), "tablet")
    # training side of a link: so many tablets of the class alone, or one with a name
    one = train.where("classes = 1").groupBy(F.col("cid").alias("ca")).agg(F.count(F.lit(1)).alias("n")).select("ca", F.lit(None).cast("string").alias("name"), "n")
    many = train.where("classes > 1").select(F.col("cid").alias("ca"), F.col("tablet").alias("name"), F.lit(1).cast("long").alias("n"))
    met = links.join(one.unionByName(many), "ca").select("cb", F.when(F.col("name").isNull(), F.col("ca")).alias("ca"), "name", "n")
    by_class = met.distinct().groupBy("cb").agg(F.sum("n").alias("pairs"))
    # evaluation tablets with one class take the class's count; the others gather theirs without repeats
    single = evals.where("classes = 1").select("tablet", F.col("cid").alias("cb")).join(by_class, "cb").select("tablet", "pairs")
    several = evals.where("classes > 1").select("tablet", F.col("cid").alias("cb")).join(met, "cb").select("tablet", "ca", "name", "n").distinct().groupBy("tablet").agg(F.sum("n").alias("pairs"))
    per_tablet = single.unionByName(several)
    return per_tablet.join(where, "tablet").groupBy("eval_split", "site").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("eval_tablets"))
