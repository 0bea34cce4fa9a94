"""Splits that keep related records together.

Compositions that share a tablet form groups, directly or through further compositions; groups
come from the random contraction of :mod:`components`, so a hot tablet or a giant group needs no
list of its members. Bins link nothing and stay apart as discovery.

The new assignment is found by swap search over whole groups. It starts from a hashed
assignment that follows the proportions; then, round after round, groups are dealt into blocks
of bounded size by a fresh hash, and all blocks anneal in parallel: a block moves a group, or
exchanges two, between splits, to lower the squared deviation of its splits' sizes and label
counts from its share of the global targets, worse steps being taken with a probability that
falls as the rounds go on. Each round's assignment is scored over all groups (a few sums) and
the best one seen is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import trimmed
from ..storage import Scratch
from .components import contract

SPLITS = ("train", "dev", "test")
PROPORTIONS = (0.8, 0.1, 0.1)
#: Groups annealed in one task; the number of blocks grows with the groups.
BLOCK_GROUPS = 4000
ROUNDS = 4
STEPS_PER_GROUP = 4
#: Labels (sites) balanced each by itself; all rarer ones are balanced as one more. Bounds the width of a row.
MAX_LABELS = 32


def _node(kind: str, c: Column) -> Column:
    return F.xxhash64(F.lit(kind), c.cast("string"))


def _bins(rows: DataFrame) -> DataFrame:
    """(cth, bin): whether any row of a composition says it is a bin."""
    return rows.groupBy("cth").agg(F.max(F.coalesce("is_bin", F.lit(False)).cast("int")).alias("bin"))


def groups(splits: DataFrame, scratch: Scratch) -> DataFrame:
    """(cth, bin, group): each composition with the number of its group; a bin is a group of its own.

    Rows without cth are left out; a row without doc_id links nothing. Compositions, integers,
    are vertices under their own numbers, so no two can be confused.
    """
    rows = splits.where("cth is not null").select(F.col("cth").cast("long").alias("cth"), "doc_id", "is_bin")
    kinds = scratch.cut(_bins(rows), "kinds")
    held = rows.where("doc_id is not null").select("doc_id", "cth").distinct().join(kinds.where("bin = 0").select("cth"), "cth")
    # a tablet links each of its compositions to the least of them: a star, not all pairs
    star = held.groupBy("doc_id").agg(F.min("cth").alias("a"), F.max("cth").alias("z")).where("a <> z")
    edges = scratch.cut(held.join(star, "doc_id").where("cth <> a").select("a", F.col("cth").alias("b")).distinct(), "edges")
    labels = contract(edges, scratch)
    if labels is None:
        return kinds.select("cth", "bin", F.col("cth").alias("group"))
    named = scratch.cut(labels.withColumnRenamed("v", "cth"), "labels")
    least = named.groupBy("round", "label").agg(F.min("cth").alias("group"))
    return kinds.join(named.join(least, ["round", "label"]).select("cth", "group"), "cth", "left").select("cth", "bin", F.coalesce("group", "cth").alias("group"))


def divided(splits: DataFrame) -> DataFrame:
    """(cth): the compositions that the present main_split divides.

    A bin is a case if one of its rows has train, dev or test; another composition if the rows
    of its group carry more than one of them. Labels compare without case and outer blanks,
    null labels say nothing, rows without cth are left out. Repeated rows change nothing; an
    empty table gives no rows.
    """
    scratch = Scratch(splits.sparkSession, "divided")
    of = scratch.cut(groups(splits, scratch), "groups")
    said = splits.where("cth is not null").select(F.col("cth").cast("long").alias("cth"), F.lower(trimmed(F.col("main_split"))).alias("label"))
    said = said.where(F.col("label").isin(*SPLITS)).groupBy("cth").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    per = of.join(said, "cth", "left").groupBy("group", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cases = per.where("(bin = 1 and lo is not null) or (bin = 0 and lo <> hi)").select("group", "bin")
    return of.join(cases, ["group", "bin"]).select(F.col("cth").cast("int").alias("cth"))


def _anneal(counts: np.ndarray, start: np.ndarray, target: np.ndarray, heat: float, seed: int, steps: int) -> np.ndarray:
    """Moves and swaps of groups between splits; ``counts`` (groups, dims), ``target`` (splits, dims).

    A group touches few labels, so a step looks at these alone. Changes are kept in a journal, from which the
    best state seen is put together at the end.
    """
    rng = np.random.default_rng(seed)
    n, parts = len(start), len(SPLITS)
    scale = 1.0 / np.maximum(target.sum(axis=0), 1.0) ** 2
    scale[0] *= len(scale)  # size weighs as much as all labels together
    gap = np.stack([counts[start == s].sum(axis=0) for s in range(parts)]) - target
    best_cost = cost = float((gap**2 * scale).sum())
    gaps, weight, now = gap.tolist(), scale.tolist(), start.tolist()
    held = [[(d, row[d]) for d in np.flatnonzero(row).tolist()] for row in counts]
    journal: list[tuple[int, int]] = []
    best_at = 0
    picks, others = rng.integers(0, n, steps).tolist(), rng.integers(0, n, steps).tolist()
    places, luck = rng.integers(1, parts, steps).tolist(), np.log(rng.random(steps)).tolist()
    for k in range(steps):
        i, j = picks[k], others[k]
        a = now[i]
        b = (a + places[k]) % parts
        moved, swap = held[i], k % 2 == 1 and now[j] == b
        if swap:
            both = dict(moved)
            for d, v in held[j]:
                both[d] = both.get(d, 0.0) - v
            moved = list(both.items())
        from_, to = gaps[a], gaps[b]
        # moving from a to b changes the two gaps only
        change = 2.0 * sum(v * weight[d] * (v + to[d] - from_[d]) for d, v in moved)
        limit = heat * (1 - k / steps) * (cost / max(n, 1) + 1e-12)
        if change <= 0 or (limit > 0 and luck[k] < -change / limit):
            for d, v in moved:
                from_[d] -= v
                to[d] += v
            now[i] = b
            journal.append((i, b))
            if swap:
                now[j] = a
                journal.append((j, a))
            cost += change
            if cost < best_cost:
                best_at, best_cost = len(journal), cost
    best = start.copy()
    for i, s in journal[:best_at]:
        best[i] = s
    return best


def _block_annealer(dims: list[str], wrong: np.ndarray, heat: float, seed: int):
    def anneal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", ignore_index=True)
        counts = pdf[dims].to_numpy(float)
        at = pdf["at"].to_numpy(int)
        held = np.stack([counts[at == s].sum(axis=0) for s in range(len(SPLITS))])
        pdf["at"] = _anneal(counts, at, held - wrong, heat, seed, STEPS_PER_GROUP * len(pdf)).astype("int32")
        return pdf[["unit", *dims, "at"]]

    return anneal


def assign(splits: DataFrame, proportions: tuple[float, float, float] = PROPORTIONS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(doc_id, cth, split): a split for each distinct pair of tablet and composition.

    Groups of related compositions are never divided; bins are discovery. A tablet with a null
    cth follows its other rows, of which the group counts before a bin; one with no cth at all
    is a group of its own. Sizes are counted in distinct tablets, labels are sites. Rows with
    neither doc_id nor cth are left out; rows without doc_id count no tablet.
    """
    spark = splits.sparkSession
    scratch = Scratch(spark, "assign")
    of = scratch.cut(groups(splits, scratch), "groups")
    rows = splits.select("doc_id", F.col("cth").cast("long").alias("cth"), "site").where("doc_id is not null or cth is not null").distinct()
    with_cth = rows.where("cth is not null").join(of, "cth").select("doc_id", "cth", "site", F.when(F.col("bin") == 1, "discovery").alias("fixed"), F.concat(F.lit("c"), F.col("group").cast("string")).alias("unit"))
    home = with_cth.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(F.col("fixed").isNotNull().alias("late"), "unit", "fixed")).alias("h"))
    without = rows.where("cth is null").join(home, "doc_id", "left").select("doc_id", "cth", "site", F.col("h.fixed").alias("fixed"), F.coalesce("h.unit", F.concat(F.lit("d"), "doc_id")).alias("unit"))
    placed = scratch.cut(with_cth.unionByName(without), "placed")
    open_rows = placed.where("fixed is null and doc_id is not null")
    # a tablet's label is its least site; labels beyond the commonest count as one more
    docs = open_rows.groupBy("unit", "doc_id").agg(F.min("site").alias("site"))
    tally = docs.groupBy("unit", F.coalesce("site", F.lit("")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    tally = scratch.cut(tally, "tally")
    top = [r.site for r in tally.groupBy("site").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "site").limit(MAX_LABELS).collect()]
    dims = ["size", *[f"s{i}" for i in range(len(top))], "rest"]
    of_site = [F.sum(F.when(F.col("site") == s, F.col("n")).otherwise(0)).cast("double").alias(f"s{i}") for i, s in enumerate(top)]
    rest = F.sum(F.when(F.col("site").isin(top), 0).otherwise(F.col("n"))).cast("double").alias("rest")
    units = tally.groupBy("unit").agg(F.sum("n").cast("double").alias("size"), *of_site, rest)
    everyone = placed.where("fixed is null").select("unit").distinct().join(units, "unit", "left").na.fill(0.0)
    u = F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(1 << 30)) / float(1 << 30)
    first = F.when(u < proportions[0], 0).when(u < proportions[0] + proportions[1], 1).otherwise(2)
    state = scratch.cut(everyone.select("unit", *dims, first.alias("at")), "state0")
    n_units = state.count()
    blocks = max(1, -(-n_units // BLOCK_GROUPS))
    schema = state.schema

    def totals(df: DataFrame) -> np.ndarray:
        out = np.zeros((len(SPLITS), len(dims)))
        for r in df.groupBy("at").agg(*[F.sum(d).alias(d) for d in dims]).collect():
            out[r["at"]] = [r[d] or 0.0 for d in dims]
        return out

    def score(t: np.ndarray) -> float:
        whole = t.sum(axis=0)
        gap = (t - np.outer(proportions, whole)) / np.maximum(whole, 1.0)
        return float((gap[:, 0] ** 2).sum() * len(dims) + (gap[:, 1:] ** 2).sum())

    now = totals(state)
    best, best_score = state, score(now)
    for r in range(rounds if n_units else 0):
        # every block is to mend an equal share of what is globally off, starting from where it stands
        wrong = (now - np.outer(proportions, now.sum(axis=0))) / blocks
        block = F.pmod(F.xxhash64(F.lit(seed + r + 1), "unit"), F.lit(blocks)).alias("block")
        state = scratch.cut(state.groupBy(block).applyInPandas(_block_annealer(dims, wrong, 1.0 - r / rounds, seed * 1000 + r), schema), f"state{r + 1}")
        now = totals(state)
        if score(now) < best_score:
            best, best_score = state, score(now)
    names = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("at") + 1)
    chosen = placed.select("doc_id", "cth", "fixed", "unit").distinct().join(best.select("unit", names.alias("open")), "unit", "left")
    return chosen.select("doc_id", F.col("cth").cast("int").alias("cth"), F.coalesce("fixed", "open").alias("split"))


def balance(splits: DataFrame, assigned: DataFrame, proportions: tuple[float, float, float] = PROPORTIONS, slack: float = 0.005) -> DataFrame:
    """(rows, divided, misplaced, balanced): what an assignment must hold, read off its rows and the input alone.

    ``divided`` counts compositions and tablets whose open rows stand in two splits, ``misplaced``
    bins outside discovery and other compositions in it; ``balanced`` says that the distinct open
    tablets follow the proportions within ``slack``. No group and no component is taken from ``assign``.
    """
    kinds = _bins(splits.where("cth is not null"))
    of = assigned.join(kinds, "cth", "left")
    open_rows = of.where("coalesce(bin, 0) = 0")
    two = [open_rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select(F.lit(1).alias("one")) for c in ("cth", "doc_id")]
    divided = two[0].unionByName(two[1]).agg(F.count("one").alias("divided"))
    counted = of.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("bin") == 1) != (F.col("split") == "discovery")).alias("misplaced"))
    sizes = of.where("split <> 'discovery' and doc_id is not null").select("doc_id", "split").distinct()
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    off = [F.abs(F.col(s) / F.col("n") - p) <= slack for s, p in zip(SPLITS, proportions)]
    fair = whole.select(F.coalesce(off[0] & off[1] & off[2], F.lit(True)).alias("balanced"))
    return counted.join(divided).join(fair).select("rows", "divided", "misplaced", "balanced")
