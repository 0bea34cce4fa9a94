"""Audits of tables: splits, leakage, duplicates, versions, identifiers, coverage, contracts, lineage."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import trimmed
from ..storage import Scratch

LABELS = ("train", "dev", "test", "discovery")


def clean_label(c: Column) -> Column:
    return F.lower(trimmed(c))


def size_band(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise("51+")


def greedy_split(weights: DataFrame, unit: str, weight: str, targets: dict[str, float]) -> DataFrame:
    """(``unit``, ``weight``, split): units, heaviest first, each to the split furthest behind its target.

    Equal weights go in the order of a hash of the unit. The rule is sequential, so one task reads the
    sorted units as a stream and keeps one number a split; units are names, not rows.
    """
    names, share = list(targets), list(targets.values())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0.0] * len(names)
        for batch in batches:
            out = []
            for w in batch.column(1).to_pylist():
                at = min(range(len(names)), key=lambda i: (held[i] / share[i], i))
                held[at] += w
                out.append(names[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [unit, weight, "split"])

    kinds = weights.select(unit, weight).schema
    ordered = weights.select(unit, weight).repartition(1).sortWithinPartitions(F.desc(weight), F.md5(F.col(unit).cast("string")), unit)
    return ordered.mapInArrow(place, f"{unit} {kinds[unit].dataType.simpleString()}, {weight} {kinds[weight].dataType.simpleString()}, split string")


def auc(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """(``by``, positives, negatives, auc): chance that a positive scores above a negative, ties counting half.

    Rows are first counted per distinct score; the running sum goes over scores, not over rows.
    """
    per = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label), 0).otherwise(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = per.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    out = below.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"))
    return out.select(*by, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.round(F.col("u") / (F.col("positives") * F.col("negatives")), 6)).alias("auc"))


def version_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(status, keys): keys common and equal, changed, only in the left or only in the right version. Null keys are left out."""
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("a"), F.lit(1).alias("l"))
    b = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("b"), F.lit(1).alias("r"))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("changed")
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("keys"))


def reconcile(left: DataFrame, right: DataFrame, passes: list[tuple]) -> DataFrame:
    """(name, l, r): identifiers of ``left`` (l) and ``right`` (r) matched in ordered passes.

    A pass is (name, form) or (name, form, mode) and compares a normal form of what earlier passes left over.
    Mode ``one`` takes forms that stand once on both sides. ``near`` compares identifiers of equal form and takes those
    an edit apart at most, if neither has another such partner. ``many`` takes any number of left ones for a
    form that stands once on the right, and leaves the right one for others.
    """
    scratch = Scratch(left.sparkSession, "reconcile")
    out, lo, ro = [], scratch.cut(left.select("l").distinct(), "left"), scratch.cut(right.select("r").distinct(), "right")

    def once(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy("k").agg(F.min(c).alias(c), F.count(F.lit(1)).alias("n")).where("n = 1 and k is not null").drop("n")

    for name, form, *mode in passes:
        a, b = lo.withColumn("k", form(F.col("l"))), ro.withColumn("k", form(F.col("r")))
        if mode == ["near"]:
            close = a.join(b, "k").where(F.levenshtein("l", "r") <= 1).select("l", "r")
            ones = [close.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(c) for c in ("l", "r")]
            met = close.join(ones[0], "l").join(ones[1], "r")
        else:
            met = (a.where("k is not null") if mode == ["many"] else once(a, "l")).join(once(b, "r"), "k")
        # each pass reads what the last one left over: written, or every pass would plan all before it again
        met = scratch.cut(met.select(F.lit(name).alias("name"), "l", "r"), f"met_{name}")
        out.append(met)
        lo = scratch.cut(lo.join(met.select("l"), "l", "left_anti"), f"left_{name}")
        if mode != ["many"]:
            ro = scratch.cut(ro.join(met.select("r"), "r", "left_anti"), f"right_{name}")
    return reduce(DataFrame.unionByName, out)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch of (id, array); zero vectors are left out."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column(1)
    m = _unit(np.asarray(lists.flatten(), np.float64).reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))
    keep = m.any(axis=1)
    return ids[keep], m[keep]


def dense_topk(vectors: DataFrame, k: int, shard: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): nearest vectors by cosine of every vector whose id is divisible by 100.

    The stated query set meets all rows in blocks: queries are packed into shards of at most ``shard``
    vectors where they are read, each shard is broadcast by itself (the driver holds one at a time),
    and one pass over the rows multiplies each batch with all shards in turn, passing on only its own k best
    per query; the partial lists are merged. Zero and null vectors take no part; a vector is no
    neighbour of itself; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null and size(embedding) > 0").select("vec_id", "embedding")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = [], []
        for batch in batches:
            for s in range(0, batch.num_rows, shard):
                i, m = _vectors(batch.slice(s, shard))
                if ids and sum(map(len, ids)) + len(i) > shard:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((np.concatenate(ids), np.concatenate(mat)))], pa.binary())], ["shard"])
                    ids, mat = [], []
                if len(i):
                    ids.append(i)
                    mat.append(m)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((np.concatenate(ids), np.concatenate(mat)))], pa.binary())], ["shard"])

    packed = Scratch(spark, "dense").cut(rows.where("vec_id % 100 = 0").mapInArrow(pack, "shard binary"), "shards", maxRecordsPerFile=1)
    held = [spark.sparkContext.broadcast(bytes(r.shard)) for r in packed.toLocalIterator()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, object] = (-1, None)
        for batch in batches:
            own, m = _vectors(batch)
            for n in range(len(held) if len(own) else 0):
                if last[0] != n:
                    last = (n, pickle.loads(held[n].value))
                    if len(held) > 1:
                        vars(held[n]).pop("_value", None)  # the worker has it on disk
                ids, mat = last[1]
                s = mat @ m.T
                s[ids[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                q = np.repeat(ids, order.shape[1])
                score = np.take_along_axis(s, order, 1).ravel()
                good = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(q[good]), pa.array(own[order.ravel()][good]), pa.array(score[good])], ["query_id", "vec_id", "score"])

    every = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def line_max(vectors: DataFrame, lines: int, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): documents by the best cosine between any of their lines and any of the query's.

    A vector is a line, ``lines`` consecutive ids are a document; queries are the documents whose number is divisible by
    100. Lines of the queries are packed and broadcast in shards as in ``dense_topk``; each batch passes on one
    number per query and document it holds lines of.
    """
    spark = vectors.sparkSession
    doc = F.floor(F.col("vec_id") / lines).cast("long")
    rows = vectors.where("embedding is not null and size(embedding) > 0").select(doc.alias("doc"), "embedding")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                ids, m = _vectors(batch.slice(s, 2048))
                if len(ids):
                    order = np.argsort(ids, kind="stable")
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((ids[order], m[order]))], pa.binary())], ["shard"])

    packed = Scratch(spark, "lines").cut(rows.where("doc % 100 = 0").mapInArrow(pack, "shard binary"), "shards", maxRecordsPerFile=1)
    held = [spark.sparkContext.broadcast(bytes(r.shard)) for r in packed.toLocalIterator()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, m = _vectors(batch)
            order = np.argsort(own, kind="stable")
            own, m = own[order], m[order]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            for b in held if len(own) else []:
                ids, mat = pickle.loads(b.value)
                if len(held) > 1:
                    vars(b).pop("_value", None)
                at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                best = np.maximum.reduceat(np.maximum.reduceat(mat @ m.T, at, axis=0), starts, axis=1)
                q, d = np.repeat(ids[at], len(starts)), np.tile(own[starts], len(at))
                keep = q != d
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(d[keep]), pa.array(best.ravel()[keep])], ["query_id", "doc_id", "score"])

    every = rows.mapInArrow(run, "query_id long, doc_id long, score double").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
