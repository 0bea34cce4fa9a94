"""Samples with quotas, splits by strata, hard sets, taxonomies and best readings with their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quota(rows: DataFrame, category: str, unit: str, order: list[str], per_category: int, fill: bool = True) -> DataFrame:
    """``rows`` with place: of each category ``per_category`` rows, one of each unit first, in the order; then, if ``fill``, others in the order.

    The first row of each unit is found first and only as many as the quota go on, so no category is sorted whole.
    """
    inner = Window.partitionBy(category, unit).orderBy(*order)
    # of one unit more rows than the quota can never be taken
    ranked = rows.withColumn("nth", F.row_number().over(inner)).where(F.col("nth") <= (per_category if fill else 1))
    outer = Window.partitionBy(category).orderBy((F.col("nth") > 1).cast("int"), *order)
    return ranked.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= per_category).drop("nth")


def stratified(units: DataFrame, unit: str, stratum: str, train: float, dev: float) -> DataFrame:
    """(``stratum``, ``unit``, split): units in the order of a hash, cut by rounded shares; strata of three units or more give dev and test one each at least."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(unit).cast("string")), unit)
    sized = units.select(stratum, unit).join(units.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum)
    placed = sized.withColumn("k", F.row_number().over(w))
    n = F.col("n")
    n_train, n_dev = F.round(n * train), F.round(n * dev)
    n_train, n_dev = F.when(n >= 3, F.least(n_train, n - 2)).otherwise(n_train), F.when(n >= 3, F.greatest(n_dev, F.lit(1))).otherwise(n_dev)
    split = F.when(F.col("k") <= n_train, "train").when(F.col("k") <= n_train + n_dev, "dev").otherwise("test")
    return placed.select(stratum, unit, split.alias("split"))


def until_enough(units: DataFrame, unit: str, weight: str, most_units: int, most_weight: int) -> DataFrame:
    """``units`` in the order of a hash up to the one with which either target is reached.

    Only the first ``most_units`` can be taken, so the running sums go over these.
    """
    first = units.select(unit, weight, F.md5(F.col(unit).cast("string")).alias("h")).orderBy("h", unit).limit(most_units)
    w = Window.orderBy("h", unit).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.coalesce(F.sum(weight).over(w), F.lit(0))).where(F.col("before") < most_weight).select(unit, weight)


def hard_quarter(rows: DataFrame, value: str) -> DataFrame:
    """The rows at or below the 25th percentile of ``value`` (interpolated); nulls are in none."""
    edge = rows.agg(F.percentile(value, 0.25).alias("edge"))
    return rows.join(F.broadcast(edge)).where(F.col(value) <= F.col("edge")).drop("edge")  # one row


def best_with_place(rows: DataFrame, key: list[str], score: str, place: list[str], above: float) -> DataFrame:
    """(``key``, best, ``place``..., n_above): the best score of each key with where it stands, ties going to the smallest place, and how many are above a bound."""
    entry = F.struct((-F.col(score)).alias("s"), *place)
    g = rows.where(F.col(score).isNotNull()).groupBy(*key).agg(F.min(entry).alias("b"), F.count_if(F.col(score) > above).alias("n_above"))
    return g.select(*key, (-F.col("b.s")).alias("best"), *[F.col(f"b.{p}") for p in place], "n_above")


def length_band(n: Column) -> Column:
    return F.when(n <= 10, n.cast("string")).when(n <= 20, "11-20").otherwise(">20")


def transfer_gap(calibrated: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """(gap, cells): mean absolute difference in points between the agreement a cell was calibrated to and the one seen, weighed by what was seen.

    Both have ``key``, accepted and exact; cells without anything accepted on either side are left out.
    """
    a = calibrated.where("accepted > 0").select(*key, (100.0 * F.col("exact") / F.col("accepted")).alias("p"))
    b = seen.where("accepted > 0").select(*key, (100.0 * F.col("exact") / F.col("accepted")).alias("q"), F.col("accepted").alias("w"))
    met = a.join(b, key)
    return met.agg(F.round(F.sum(F.abs(F.col("p") - F.col("q")) * F.col("w")) / F.sum("w"), 6).alias("gap"), F.count(F.lit(1)).alias("cells"))


def adjacency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, partner): both directions of every pair, each once; pairs with a null or of an id with itself say nothing."""
    real = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = real.select(F.explode(F.array(F.struct(F.col(a).alias("id"), F.col(b).alias("partner")), F.struct(F.col(b).alias("id"), F.col(a).alias("partner")))).alias("e"))
    return both.select("e.id", "e.partner").distinct()


def unlinked_pairs(members: DataFrame, group: str, member: str, known: DataFrame) -> DataFrame:
    """(``group``, members, pairs, known, left): pairs within each group, those already known, and what is left of them.

    Counted, not listed: a group of n has n (n - 1) / 2 pairs, of which the known ones (member_a, member_b, either way round) that
    lie within it are taken off.
    """
    of = members.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    sizes = of.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    one = known.where("member_a is not null and member_b is not null and member_a <> member_b").select(F.least("member_a", "member_b").alias("x"), F.greatest("member_a", "member_b").alias("y")).distinct()
    inside = one.join(of.select(group, F.col(member).alias("x")), "x").join(of.select(group, F.col(member).alias("y")), [group, "y"]).groupBy(group).agg(F.count(F.lit(1)).alias("known"))
    full = sizes.join(inside, group, "left").withColumn("known", F.coalesce("known", F.lit(0)))
    pairs = F.expr("members * (members - 1) div 2")
    return full.select(group, "members", pairs.alias("pairs"), "known", (pairs - F.col("known")).alias("left"))
