"""When to present a candidate and when to abstain: rules, selection, folds, candidate sets, horizons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import pct, wilson

# The grid of acceptance rules and the targets a rule is chosen for.
SUPPORTS = (1, 2, 3, 4)
MARGINS = (1, 2, 3)
DOMINANCES = (0.0, 0.5, 0.67, 0.8, 1.0)
ALTERNATIVES = (1, 2, 4, 8, None)
TARGETS = (0.7, 0.8, 0.9, 0.95)
MIN_ACCEPTS = 50

#: What a rule looks at; spans alike in all of these are counted together before rules are tried.
FEATURES = ("top", "margin", "dominance", "n_alt", "unique_top", "top_exact")


def rules(spark: SparkSession) -> DataFrame:
    """(rule_id, min_support, min_margin, min_dominance, max_alternatives): all 300 rules; null is no maximum."""
    rows = []
    for s in SUPPORTS:
        for m in MARGINS:
            for d in DOMINANCES:
                for a in ALTERNATIVES:
                    name = f"s{s}_m{m}_d{d}".replace(".", "p") + f"_a{'any' if a is None else a}"
                    rows.append((name, s, m, d, a))
    return spark.createDataFrame(rows, "rule_id string, min_support int, min_margin int, min_dominance double, max_alternatives int")


def profile(standing: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Counts of spans with equal features per ``keys``: the only thing rules are evaluated on. ``weight`` says how many spans a row stands for."""
    return standing.groupBy(*keys, *FEATURES).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def abstaining(counts: DataFrame, *keys: str) -> DataFrame:
    """Profile rows of spans without any proposal; ``counts`` has the keys and n."""
    none = {"top": F.lit(0).cast("long"), "margin": F.lit(0).cast("long"), "dominance": F.lit(0.0), "n_alt": F.lit(0).cast("long"), "unique_top": F.lit(False), "top_exact": F.lit(False)}
    return counts.where("n > 0").select(*keys, *[none[f].alias(f) for f in FEATURES], "n")


def accepts() -> Column:
    """Whether a rule accepts a span: a unique top with enough support, margin and dominance and few enough alternatives."""
    return (F.col("unique_top") & (F.col("top") >= F.col("min_support")) & (F.col("margin") >= F.col("min_margin"))
            & (F.col("dominance") >= F.col("min_dominance")) & (F.col("max_alternatives").isNull() | (F.col("n_alt") <= F.col("max_alternatives"))))


def evaluate(profiles: DataFrame, rule_table: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, rule_id, eligible, accepted, exact, coverage, lower, upper) of every rule.

    The 300 rules are a fixed table, so they may be broadcast whatever the profiles hold.
    """
    met = profiles.join(F.broadcast(rule_table))
    agg = met.groupBy(*keys, "rule_id").agg(
        F.sum("n").alias("eligible"), F.sum(F.when(accepts(), F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(accepts() & F.col("top_exact"), F.col("n")).otherwise(0)).alias("exact"))
    low, high = wilson(F.col("exact"), F.col("accepted"))
    return agg.select("*", pct(F.col("accepted"), F.col("eligible")).alias("coverage"), low.alias("lower"), high.alias("upper"))


def choose(evaluated: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, target, rule_id, ...): the rule of most coverage whose lower bound reaches the target, per target.

    Ties go to the higher lower bound, then to the rule id. A target no rule reaches has no row.
    """
    spark = evaluated.sparkSession
    targets = spark.createDataFrame([(t,) for t in TARGETS], "target double")
    fit = evaluated.where(F.col("accepted") >= MIN_ACCEPTS).join(F.broadcast(targets), F.col("lower") >= F.col("target"))
    w = Window.partitionBy(*keys, "target").orderBy(F.desc("coverage"), F.desc("lower"), "rule_id")
    return fit.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def greedy_folds(weights: DataFrame, unit: str, weight: str, folds: int) -> DataFrame:
    """(``unit``, ``weight``, fold): units, heaviest first, each to the fold of least weight, then fewest units, then number.

    A sequential rule over the units (sources, compositions), of which there are as many as the
    collection has names for, not as it has rows: one task reads them sorted as a stream.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(0, 0, i) for i in range(folds)]
        for batch in batches:
            out = []
            for w in batch.column(1).to_pylist():
                load, units, fold = min(held)
                held[fold] = (load + w, units + 1, fold)
                out.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [unit, weight, "fold"])

    kinds = weights.select(unit, weight).schema
    ordered = weights.select(unit, weight).repartition(1).sortWithinPartitions(F.desc(weight), unit)
    return ordered.mapInArrow(place, f"{unit} {kinds[unit].dataType.simpleString()}, {weight} {kinds[weight].dataType.simpleString()}, fold int")


def cross_calibrate(profiles: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(fold, target, rule_id, eligible, accepted, exact, coverage, agreement, reached): calibrated on the other folds, judged on its own.

    ``profiles`` has a column fold. Where no rule fits on the other folds the fold abstains
    wholly: a row with null rule_id and nothing accepted.
    """
    spark = profiles.sparkSession
    per_fold = evaluate(profiles, rule_table, "fold").select("fold", "rule_id", "eligible", "accepted", "exact")
    whole = per_fold.groupBy("rule_id").agg(F.sum("eligible").alias("te"), F.sum("accepted").alias("ta"), F.sum("exact").alias("tx"))
    # the other folds' counts are the totals less the fold's own: no second pass over the spans
    other = per_fold.join(whole, "rule_id").select(
        "fold", "rule_id", (F.col("te") - F.col("eligible")).alias("eligible"), (F.col("ta") - F.col("accepted")).alias("accepted"), (F.col("tx") - F.col("exact")).alias("exact"))
    low, _ = wilson(F.col("exact"), F.col("accepted"))
    fitted = choose(other.select("*", pct(F.col("accepted"), F.col("eligible")).alias("coverage"), low.alias("lower")), "fold").select("fold", "target", "rule_id")
    frame = per_fold.select("fold", "eligible").distinct().join(F.broadcast(spark.createDataFrame([(t,) for t in TARGETS], "target double")))
    own = per_fold.select("fold", "rule_id", "accepted", "exact")
    out = frame.join(fitted, ["fold", "target"], "left").join(own, ["fold", "rule_id"], "left")
    n, x = F.coalesce("accepted", F.lit(0)).cast("long"), F.coalesce("exact", F.lit(0)).cast("long")
    return out.select(
        "fold", "target", "rule_id", "eligible", n.alias("accepted"), x.alias("exact"), pct(n, F.col("eligible")).alias("coverage"),
        pct(x, n).alias("agreement"), F.when(n > 0, x >= F.col("target") * n).otherwise(F.lit(False)).alias("reached"))


def ranked(voted: DataFrame, ids: list[str]) -> DataFrame:
    """Proposals of each span with their rank: support down, then the proposal's own order (for display only)."""
    w = Window.partitionBy(*ids).orderBy(F.desc("support"), "middle")
    return voted.withColumn("rank", F.row_number().over(w))


def tie_complete(ranked_votes: DataFrame, ids: list[str], depth: int) -> DataFrame:
    """Everything with at least the support of the ``depth``-th proposal."""
    w = Window.partitionBy(*ids).orderBy(F.desc("support"))
    return ranked_votes.withColumn("tie_rank", F.rank().over(w)).where(F.col("tie_rank") <= depth)


# The names of the categories.
def disagreement(rank: Column, top_len: Column, gold_len: Column) -> Column:
    """What kind of disagreement there is between the top proposal and the attested reading."""
    return (F.when(rank == 1, "TOP_EXACT_ATTESTED_AGREEMENT").when(rank.isNotNull(), "ATTESTED_READING_LOWER_RANKED")
            .when(top_len == 0, "ATTESTED_READING_ABSENT_TOP_OMISSION").when(top_len < gold_len, "ATTESTED_READING_ABSENT_TOP_SHORTER")
            .when(top_len == gold_len, "ATTESTED_READING_ABSENT_TOP_EQUAL_LENGTH_DIFFERENT").otherwise("ATTESTED_READING_ABSENT_TOP_LONGER"))
