"""Composite documents: members and the lines they share, tiers of joins, lost edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many shared lines make a tier, and what an exclusive side must still hold to be tested.
TIER_B_LINES, MIN_SIGNS, MIN_LINES = 2, 8, 2


# The names of the geometries.
def member_pairs(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(parent, member_a, member_b, declared, n_shared, first_shared, last_shared, geometry): members that stand side by side, or share a line.

    ``members`` has parent, member and ord (its place in the declared chain); ``lines`` has parent, line and
    member, one row for each member a line belongs to. Pairs come from single lines, whose members are
    those of one composite. Members of a declared pair without shared lines have a pair too; parents
    with one member have none.
    """
    several = members.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent")
    kept = members.join(several, "parent", "left_semi").select("parent", "member", "ord")
    nxt = kept.select("parent", F.col("member").alias("other"), (F.col("ord") - 1).alias("ord"))
    pair = [F.least("member", "other").alias("member_a"), F.greatest("member", "other").alias("member_b")]
    declared = kept.join(nxt, ["parent", "ord"]).select("parent", *pair, F.lit(True).alias("declared")).distinct()
    of_line = lines.join(kept.select("parent", "member"), ["parent", "member"], "left_semi").groupBy("parent", "line").agg(F.array_sort(F.collect_set("member")).alias("ms"))
    left = of_line.where(F.size("ms") > 1).select("parent", "line", "ms", F.posexplode("ms").alias("i", "member_a"))
    both = left.select("parent", "line", "member_a", F.explode(F.slice("ms", F.col("i") + 2, F.greatest(F.size("ms") - F.col("i") - 1, F.lit(0)))).alias("member_b"))
    shared = both.groupBy("parent", "member_a", "member_b").agg(F.count(F.lit(1)).alias("n_shared"), F.min("line").alias("first_shared"), F.max("line").alias("last_shared"))
    met = declared.join(shared, ["parent", "member_a", "member_b"], "full")
    n = F.coalesce("n_shared", F.lit(0))
    run = F.col("last_shared") - F.col("first_shared") + 1
    geometry = (F.when(n == 0, "no_overlap_seam").when(n <= TIER_B_LINES, "seam_single_line_transition").when(run <= n + 2, "extended_overlap_duplicate_like").otherwise("unclear"))
    return met.select("parent", "member_a", "member_b", F.coalesce("declared", F.lit(False)).alias("declared"), n.alias("n_shared"), "first_shared", "last_shared", geometry.alias("geometry"))


def quarantined(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(parent): composites of several members of which no line names any: nothing can be taken apart."""
    several = members.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent")
    named = lines.join(members.select("parent", "member"), ["parent", "member"], "left_semi").select("parent")
    return several.join(named, "parent", "left_anti")


def tier(n_shared: Column) -> Column:
    return F.when(n_shared == 0, "A").when(n_shared <= TIER_B_LINES, "B").otherwise("C")


def tiered(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` with tier, layout, and of tier C what each side has to itself (lines, signs) and whether that is too little to test.

    ``lines`` has parent, line, member and signs (a number).
    """
    out = pairs.withColumn("tier", tier(F.col("n_shared")))
    wide = out.where("tier = 'C'").select("parent", "member_a", "member_b")

    def exclusive(own: str, other: str, tag: str) -> DataFrame:
        mine = wide.join(lines.select("parent", F.col("member").alias(own), "line", "signs"), ["parent", own])
        theirs = lines.select("parent", F.col("member").alias(other), "line").distinct()
        left = mine.join(theirs, ["parent", other, "line"], "left_anti")
        return left.groupBy("parent", "member_a", "member_b").agg(F.count(F.lit(1)).alias(f"lines_{tag}"), F.sum("signs").alias(f"signs_{tag}"))

    key = ["parent", "member_a", "member_b"]
    full = out.join(exclusive("member_a", "member_b", "a"), key, "left").join(exclusive("member_b", "member_a", "b"), key, "left")
    c = F.col("tier") == "C"
    own = {f"{w}_{t}": F.when(c, F.coalesce(f"{w}_{t}", F.lit(0))).cast("long") for w in ("lines", "signs") for t in "ab"}
    poor = (own["signs_a"] < MIN_SIGNS) | (own["signs_b"] < MIN_SIGNS) | (own["lines_a"] < MIN_LINES) | (own["lines_b"] < MIN_LINES)
    return full.select(*pairs.columns, "tier", F.when(c, "horizontal").otherwise("vertical").alias("layout"), *[v.alias(k) for k, v in own.items()], F.when(c, poor).alias("untestable"))


def edge_profile(lines: DataFrame, key: str) -> DataFrame:
    """(``key``, lines, top_lost, bottom_lost, first_state, last_state): which ends of a document are lost.

    ``lines`` has ``key``, line, gap (only a gap is left), prime (the number is counted from a break), edge
    (the physical edge it stands on: upper, lower or null), first and last (states of its first and last
    word). The top is lost if a gap stands before the first line with text or that line is primed, the
    bottom if a gap stands behind the last; a preserved physical edge overrides either. Documents
    without a line of text have no row.
    """
    text = F.when(~F.col("gap"), F.col("line"))
    ends = lines.groupBy(key).agg(
        F.min(text).alias("lo"), F.max(text).alias("hi"), F.min(F.when(F.col("gap"), F.col("line"))).alias("gap_lo"), F.max(F.when(F.col("gap"), F.col("line"))).alias("gap_hi"),
        F.count_if(~F.col("gap")).alias("lines"), F.max((F.col("edge") == "upper").cast("int")).alias("upper"), F.max((F.col("edge") == "lower").cast("int")).alias("lower"),
        F.min_by("prime", text).alias("prime"), F.min_by("first", text).alias("first_state"), F.max_by("last", text).alias("last_state")).where("lo is not null")
    top = (F.coalesce("upper", F.lit(0)) == 0) & (F.coalesce(F.col("gap_lo") < F.col("lo"), F.lit(False)) | F.coalesce("prime", F.lit(False)))
    bottom = (F.coalesce("lower", F.lit(0)) == 0) & F.coalesce(F.col("gap_hi") > F.col("hi"), F.lit(False))
    return ends.select(key, "lines", top.alias("top_lost"), bottom.alias("bottom_lost"), "first_state", "last_state")
