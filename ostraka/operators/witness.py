"""Recoverability of masked spans from independent parallel passages.

A span of ``mask`` tokens inside a line is hidden; ``anchors`` tokens on each side stay. A
witness is any line of the same scope, of another family, where the same anchors enclose a
middle of at most ``max_middle`` tokens (the empty middle, an omission, is a proposal too).
Families vote once per middle; a span's own family never votes.

A window is a pair of anchors with what they enclose, and a span is a window whose middle has the
length of the mask, so one table of windows serves as index and as question. Spans never meet the
families of their anchors one by one, which grows with the square of a formula's occurrences.
What a span is told is put together from counts of its anchor pair, less what its own family put
into them, which each is an aggregation that grows with the windows (``passages`` tells it bucket by bucket, without a table of them):

* the support S of a middle is the number of its families; a family that proposes it sees S - 1;
* the number of middles is that of the pair, less those only the own family has;
* the best two supports are among the two highest levels of the pair, each less one for own middles;
* the first d proposals are among the first d plus the own ones of the pair.

Windows are keyed by 128 bits of scope and anchors (k1, k2) and 64 bits of the middle within them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch

MAX_MIDDLE = 12
#: Stands between the tokens of a key; no token holds it.
MARK = "\x1f"
PAIR = ["k1", "k2"]
#: Hashes of anchors, or of anchor pairs, 8 bytes each, that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def windows(lines: DataFrame, anchors: int, scope: str, unit: str, max_middle: int = MAX_MIDDLE, spelled: bool = False, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, start, len, scope, unit, family, k1, k2, m): every window of every line; ``start`` is where the middle begins.

    ``m`` is a hash of the middle, or its tokens joined by ``MARK`` if ``spelled``. Only windows between
    anchors in ``among`` (g, as ``shared_anchors`` hashes them) are made, where it is given.
    """
    names = ["doc_id", "line", F.col(scope).alias("scope"), F.col(unit).alias("unit"), "family"]
    kept = ["doc_id", "line", "scope", "unit", "family"]
    long_enough = lines.where(F.size("tokens") >= 2 * anchors)
    parts = ["h", "t"] if spelled else ["h"]
    hashed = long_enough.select(*names, F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"), *([F.col("tokens").alias("t")] if spelled else []))
    at = hashed.select(*kept, *parts, F.explode(F.sequence(F.lit(1), F.size("h") - (2 * anchors - 1))).alias("i"))
    # each row keeps only the stretch its windows lie in
    near = at.select(*kept, (F.col("i") - 1 + anchors).alias("start"), F.slice("h", F.col("i"), anchors).alias("l"), *[F.slice(p, F.col("i") + anchors, max_middle + anchors).alias(p) for p in parts])
    if among is not None:
        near = near.join(among, F.xxhash64("scope", "l") == F.col("g"), "left_semi")
    each = near.select(*kept, "start", "l", *parts, F.explode(F.sequence(F.lit(0), F.size("h") - anchors)).alias("len"))
    r = F.slice("h", F.col("len") + 1, anchors)
    if among is not None:
        each = each.join(among, F.xxhash64("scope", r) == F.col("g"), "left_semi")
    middle = F.slice("t" if spelled else "h", F.lit(1), F.col("len"))
    return each.select(
        "doc_id", "line", "start", "len", "scope", "unit", "family", F.xxhash64("scope", "l", r).alias("k1"), F.xxhash64(F.lit(7), "scope", "l", r).alias("k2"),
        (F.array_join(middle, MARK) if spelled else F.xxhash64(middle)).alias("m"))


def shared_anchors(lines: DataFrame, anchors: int, scope: str) -> DataFrame | None:
    """(g): hashes of scope and anchor, of the anchors that two families have, for a broadcast; None where they are too many for one."""
    hashed = lines.where(F.size("tokens") >= 2 * anchors).select(F.col(scope).alias("scope"), "family", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    at = hashed.select("scope", "family", "h", F.explode(F.sequence(F.lit(1), F.size("h") - (anchors - 1))).alias("i"))
    grams = at.select(F.xxhash64("scope", F.slice("h", F.col("i"), anchors)).alias("g"), "family")
    shared = grams.groupBy("g").agg(F.min("family").alias("a"), F.max("family").alias("z")).where("a <> z").select("g")
    written = Scratch(lines.sparkSession, "anchors").cut(shared, "shared")
    return F.broadcast(written) if written.count() <= BROADCAST_KEYS else None  # a checked size; it only spares work


def masked_spans(lines: DataFrame, anchors: int, mask: int, scope: str, unit: str) -> DataFrame:
    """The windows whose middle, the gold reading, has ``mask`` tokens: every span inside a line with whole anchors on both sides."""
    return windows(lines, anchors, scope, unit, mask, spelled=True).where(F.col("len") == mask)


def counted(lines: DataFrame, anchors: int, masks: list[int], scope: str, unit: str, max_middle: int = MAX_MIDDLE, spelled: bool = False) -> DataFrame:
    """(k1, k2, m, family, scope, unit, len, c): windows alike in all of these, counted, of the anchor pairs that enclose a span and that two families have.

    No other pair brings a proposal to anything asked, and these are few; three numbers per pair tell
    them, so what is shuffled in full is only what can matter. (They are told by half of the key: that
    two pairs share it by chance costs a few rows and changes no result.)
    """
    # an anchor of one family alone is in no pair that matters
    every = windows(lines, anchors, scope, unit, max_middle, spelled, shared_anchors(lines, anchors, scope))
    pairs = every.groupBy("k1").agg(F.min("family").alias("a"), F.max("family").alias("z"), F.max(F.col("len").isin(masks)).alias("asked"))
    wanted = Scratch(lines.sparkSession, "pairs").cut(pairs.where("a <> z and asked").select("k1"), "wanted")
    if wanted.count() <= BROADCAST_KEYS:  # a checked size; beyond it the windows are shuffled to the keys
        wanted = F.broadcast(wanted)
    return every.join(wanted, "k1", "left_semi").groupBy(*PAIR, "m", "family", "scope", "unit", "len").agg(F.count(F.lit(1)).alias("c"))


def eligible_scopes(lines: DataFrame, scope: str) -> DataFrame:
    """(scope): scopes with at least two families, where a span can have an independent witness."""
    return lines.groupBy(F.col(scope).alias("scope")).agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b").select("scope")


def eligible(lines: DataFrame, anchors: int, masks: list[int], scope: str, unit: str) -> DataFrame:
    """(mask, scope, unit, eligible): spans inside lines of eligible scopes, counted from the lengths of the lines."""
    n = [F.greatest(F.size("tokens") - (2 * anchors + m - 1), F.lit(0)).cast("long") for m in masks]
    sized = lines.select(F.col(scope).alias("scope"), F.col(unit).alias("unit"), *[c.alias(f"n{m}") for c, m in zip(n, masks)])
    sums = sized.groupBy("scope", "unit").agg(*[F.sum(f"n{m}").alias(f"n{m}") for m in masks]).join(eligible_scopes(lines, scope), "scope", "left_semi")
    tall = sums.select("scope", "unit", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(f"n{m}").alias("eligible")) for m in masks])).alias("x"))
    return tall.select("x.mask", "scope", "unit", "x.eligible").where("eligible > 0")


def _cells(lines: DataFrame, anchors: list[int], masks: list[int], scope: str, unit: str, max_middle: int) -> DataFrame:
    """(anchors, mask, unit, eligible, supported, exact, variant_only, ambiguous, abstained)."""
    from . import passages  # which has the windows from here

    known = passages.Passages(lines, scope, unit)
    told = passages.census(known, anchors, masks, max_middle).withColumnRenamed("anchors", "of").withColumnRenamed("mask", "len").withColumnRenamed("unit", "u")
    asked = reduce(DataFrame.unionByName, [eligible(known.lines, a, masks, "scope", "unit").groupBy("mask", "unit").agg(F.sum("eligible").alias("eligible")).select(F.lit(a).alias("anchors"), "*") for a in anchors])
    full = asked.join(told, (F.col("anchors") == F.col("of")) & (F.col("mask") == F.col("len")) & F.col("unit").eqNullSafe(F.col("u")), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("supported", "exact", "variant_only", "ambiguous")]
    return full.select("anchors", "mask", "unit", "eligible", *counts, (F.col("eligible") - F.coalesce("supported", F.lit(0))).alias("abstained"))


def census_cells(lines: DataFrame, anchors: int, masks: list[int], scope: str, unit: str, max_middle: int = MAX_MIDDLE) -> DataFrame:
    """(mask, unit, eligible, supported, exact, variant_only, ambiguous, abstained) of all masks at once, which must be at most ``max_middle``."""
    return _cells(lines, [anchors], masks, scope, unit, max_middle).drop("anchors")


def census(lines: DataFrame, anchors: int, mask: int, scope: str, unit: str, max_middle: int = MAX_MIDDLE) -> DataFrame:
    """(unit, eligible, supported, exact, variant_only, ambiguous, abstained): counts of spans per unit."""
    return census_cells(lines, anchors, [mask], scope, unit, max_middle).drop("mask").withColumnRenamed("unit", unit)


def census_grid(lines: DataFrame, anchors: list[int], masks: list[int], scope: str, unit: str) -> DataFrame:
    """The census summed over all units for each anchor and mask length; a bucket of windows serves all of them."""
    sums = [F.sum(x).alias(x) for x in ("eligible", "supported", "exact", "variant_only", "ambiguous", "abstained")]
    return _cells(lines, anchors, masks, scope, unit, MAX_MIDDLE).groupBy("anchors", "mask").agg(*sums)


def supports(window_counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Votes before a span's own family is taken out, from ``counted``.

    (k1, k2, m, s): support of each middle. (k1, k2, n_middles, total, levels): per pair, ``levels``
    the distinct supports with their number of middles, highest first; of n votes there are at most
    sqrt(2 n). (k1, k2, family, own): the supports of the middles a family itself proposes.
    """
    voters = window_counts.select(*PAIR, "m", "family").distinct()
    middles = voters.groupBy(*PAIR, "m").agg(F.count(F.lit(1)).alias("s"))
    levels = middles.groupBy(*PAIR, "s").agg(F.count(F.lit(1)).alias("n"))
    pairs = levels.groupBy(*PAIR).agg(
        F.sum("n").alias("n_middles"), F.sum(F.col("s") * F.col("n")).alias("total"), F.sort_array(F.collect_list(F.struct("s", "n")), asc=False).alias("levels"))
    own = voters.join(middles, [*PAIR, "m"]).groupBy(*PAIR, "family").agg(F.collect_list("s").alias("own"))
    return middles, pairs, own


def _copies(value: Column, n: Column) -> Column:
    """``value`` as often as ``n`` says, twice at most."""
    return F.array_repeat(value, F.least(F.greatest(n, F.lit(0)), F.lit(2)).cast("int"))


def _own_at(level: Column) -> Column:
    """How many middles of the family itself have the support ``level``."""
    return F.size(F.filter("own", lambda x: x == level))


def standings(window_counts: DataFrame, masks: list[int]) -> DataFrame:
    """(k1, k2, m, family, n_alt, total, top, runner_up, gold_support, margin, unique_top, dominance, top_exact): how spans stand, alike for all spans of one family with the same anchors and middle.

    Spans without any proposal have no row.
    """
    middles, pairs, own = supports(window_counts)
    spans = window_counts.where(F.col("len").isin(masks)).select(*PAIR, "m", "family").distinct()
    met = spans.join(pairs, PAIR).join(middles, [*PAIR, "m"]).join(own, [*PAIR, "family"])
    first, second = F.get("levels", F.lit(0)), F.get("levels", F.lit(1))
    s1, n1 = first["s"], first["n"]
    s2, n2 = F.coalesce(second["s"], F.lit(0)), F.coalesce(second["n"], F.lit(0))
    of = {i: _own_at(level) for i, level in ((1, s1), (2, s2), (0, F.lit(1)))}
    # two highest levels hold two middles at least, none of which falls below the third: the best two are among them
    best = F.sort_array(F.concat(_copies(s1, n1 - of[1]), _copies(s1 - 1, of[1]), _copies(s2, n2 - of[2]), _copies(s2 - 1, of[2])), asc=False)
    told = met.select(
        *PAIR, "m", "family", (F.col("n_middles") - of[0]).alias("n_alt"), (F.col("total") - F.size("own")).alias("total"),
        F.coalesce(F.get(best, F.lit(0)), F.lit(0)).alias("top"), F.coalesce(F.get(best, F.lit(1)), F.lit(0)).alias("runner_up"), (F.col("s") - 1).alias("gold_support"))
    full = told.where("n_alt > 0").withColumn("margin", F.col("top") - F.col("runner_up")).withColumn("unique_top", F.col("margin") > 0)
    return full.withColumn("dominance", F.col("top") / F.col("total")).withColumn("top_exact", F.col("unique_top") & (F.col("gold_support") == F.col("top")))


def candidates(window_counts: DataFrame, masks: list[int], depth: int) -> DataFrame:
    """(k1, k2, m, family, n_alt, gold_support, first, levels, own): the first ``depth`` proposals of spans, as ``standings`` alike for many.

    ``first`` lists (rival, m, support), support down, then the proposal's own order; ``m`` is spelled
    in ``window_counts``. Spans without any proposal have no row.
    """
    middles, pairs, own = supports(window_counts)
    spans = window_counts.where(F.col("len").isin(masks)).select(*PAIR, "m", "family").distinct()
    asked = spans.select(*PAIR, "family").distinct().join(own, [*PAIR, "family"])
    most = asked.agg(F.max(F.size("own"))).first()[0] or 0
    # a limit that does not depend on the row lets the ranking be cut before it is shuffled
    w = Window.partitionBy(*PAIR).orderBy(F.desc("s"), "m")
    ranked = middles.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth + most)
    voters = window_counts.select(*PAIR, "m", "family").distinct().withColumn("mine", F.lit(1))
    met = asked.select(*PAIR, "family", F.size("own").alias("k")).join(ranked, PAIR).where(F.col("r") <= depth + F.col("k"))
    left = met.join(voters, [*PAIR, "m", "family"], "left").select(*PAIR, "family", "m", (F.col("s") - F.coalesce("mine", F.lit(0))).alias("support")).where("support > 0")
    lists = left.groupBy(*PAIR, "family").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("rival"), "m", "support"))), 1, depth).alias("first"))
    full = spans.join(pairs, PAIR).join(middles, [*PAIR, "m"]).join(own, [*PAIR, "family"]).join(lists, [*PAIR, "family"])
    return full.select(*PAIR, "m", "family", (F.col("n_middles") - _own_at(F.lit(1))).alias("n_alt"), (F.col("s") - 1).alias("gold_support"), "first", "levels", "own")


def gold_rank(first: Column, gold: Column) -> Column:
    """Place of the gold middle among the first proposals; null where it is not there."""
    at = F.array_position(F.transform(first, lambda x: x["m"]), gold)
    return F.when(at > 0, at)


def tied_size(first: Column, n_alt: Column, levels: Column, own: Column, depth: int) -> tuple[Column, Column]:
    """(support, size) of the proposals shown to ``depth`` with all that are tied with the last of them."""
    last = F.when(n_alt > depth, F.get(first, F.lit(depth - 1))["support"]).otherwise(F.lit(1))
    above = F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + F.when(x["s"] >= last, x["n"]).otherwise(0))
    return last, F.when(n_alt > depth, above - F.size(F.filter(own, lambda x: x == last))).otherwise(n_alt)


def formulaicity(window_rows: DataFrame, masks: list[int], scopes: DataFrame) -> DataFrame:
    """(k1, k2, units): in how many units each anchor pair of a span occurs, whatever it encloses."""
    wanted = window_rows.where(F.col("len").isin(masks)).join(scopes, "scope", "left_semi").select(*PAIR).distinct()
    return window_rows.where("unit is not null").select(*PAIR, "unit").distinct().groupBy(*PAIR).agg(F.count(F.lit(1)).alias("units")).join(wanted, PAIR, "left_semi")


def occurrence_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open stretches of one line meet."""
    return (a_start < b_end) & (b_start < a_end)
