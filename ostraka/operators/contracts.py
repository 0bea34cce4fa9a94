"""Contracts that stop a job, findings that only warn, evidence policy and provenance.

Each contract comes as a table of what breaks it, which a report may count, and through ``stop``,
which raises inside the plan as soon as a row breaks it, so nothing behind it is computed from bad rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

SPLITS = ("train", "dev", "test", "discovery")
# Classes of evidence, the least interpretive first, and what named policies admit.
EVIDENCE = (
    "SYSTEM_TECHNICAL", "OBSERVED_ARTIFACT", "OBSERVED_DOCUMENT_STRUCTURE", "CATALOG_METADATA", "EDITORIAL_TRANSCRIPTION", "EDITORIAL_RESTORATION", "EDITORIAL_RELATION", "MODEL_DERIVED",
)
_BASE = ("OBSERVED_ARTIFACT", "OBSERVED_DOCUMENT_STRUCTURE", "SYSTEM_TECHNICAL")
POLICIES = {
    "artifact_strict": _BASE,
    "transcription_assisted": (*_BASE, "EDITORIAL_TRANSCRIPTION"),
    "catalog_assisted": (*_BASE, "EDITORIAL_TRANSCRIPTION", "CATALOG_METADATA"),
    "scholar_assisted": (*_BASE, "EDITORIAL_TRANSCRIPTION", "CATALOG_METADATA", "EDITORIAL_RESTORATION"),
    "discovery_assisted": (*_BASE, "EDITORIAL_TRANSCRIPTION", "CATALOG_METADATA", "EDITORIAL_RESTORATION", "MODEL_DERIVED"),
}


def stop(rows: DataFrame, breach: Column, message: str) -> DataFrame:
    """``rows`` unchanged; a row for which ``breach`` is true or unknown stops the job."""
    checked = F.when(F.coalesce(breach, F.lit(True)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return rows.where(checked)


def guard(ids: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(``key``, breach): why an id may not be read for training or scoring: missing, unknown_split or test, the first that holds; null where it may.

    ``labels`` has ``key`` and label, one row an id; an id without a label is no id with another label.
    """
    met = ids.select(key).distinct().join(labels.select(key, "label", F.lit(1).alias("known")), key, "left")
    return met.select(key, F.when(F.col("known").isNull() | F.col("label").isNull(), "missing").when(~F.col("label").isin(*SPLITS), "unknown_split").when(F.col("label") == "test", "test").alias("breach"))


def guarded(ids: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``ids`` if none is missing, unknown or of the test side; else the job stops."""
    judged = guard(ids, labels, key)
    return stop(ids.join(judged, key), F.col("breach").isNotNull(), "an id is missing, of an unknown split or of the test side").drop("breach")


def dev_only(split: str) -> None:
    if split != "dev":
        raise ValueError(f"selection reads dev only, not {split}")


def parallel(*lists: Column) -> Column:
    """Whether lists of one row have equal lengths; null lists do not."""
    sizes = [F.size(x) for x in lists]
    return F.coalesce(reduce(lambda a, b: a & b, [(sizes[0] == s) & (s >= 0) for s in sizes]), F.lit(False))


def lexical(tokens: Column, structure: tuple[str, ...]) -> Column:
    """Whether a list has a token that is not structure."""
    return F.coalesce(F.exists(tokens, lambda t: ~t.isin(*structure)), F.lit(False))


def unreachable(truth: DataFrame, candidates: DataFrame, declared: DataFrame) -> DataFrame:
    """(query, gold): true partners that are no candidates and not declared so, by query or by (query, gold).

    ``truth`` has query and gold, ``candidates`` has gold, ``declared`` has query and gold, null for all of a query.
    """
    left = truth.select("query", "gold").distinct().join(candidates.select("gold").distinct(), "gold", "left_anti")
    whole = declared.where("gold is null").select("query").distinct()
    single = declared.where("gold is not null").select("query", "gold").distinct()
    return left.join(whole, "query", "left_anti").join(single, ["query", "gold"], "left_anti").select("query", "gold")


def stamp(records: DataFrame, universe: str, *columns: str) -> DataFrame:
    """(universe, n, content): name, size and a digest of a universe that does not depend on the order of its rows."""
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(digest, F.lit(0)).cast("string").alias("content")).select(F.lit(universe).alias("universe"), "n", "content")


def expect_stamp(stamped: DataFrame, universe: str, n: int) -> DataFrame:
    return stop(stamped, (F.col("universe") != universe) | (F.col("n") != n), f"statistics are not those of {universe} with {n} records")


def feature_health(rows: DataFrame, features: list[str], floor: float = 1e-6) -> DataFrame:
    """(feature, n, not_finite, mean, std, low, high, degenerate): population figures of each feature; without spread, or not finite, it is degenerate."""
    tall = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.feature", "x.v").where("v is not null")
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    g = tall.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("not_finite"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.var_pop("v").alias("var"))
    return g.select("feature", "n", "not_finite", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")], ((F.col("var") < floor) | (F.col("not_finite") > 0)).alias("degenerate"))


def against_intent(coefficients: DataFrame) -> DataFrame:
    """Rows of (feature, coefficient, intent) whose sign contradicts the intent; zero and undeclared ones say nothing."""
    return coefficients.where("intent is not null and coefficient <> 0 and (coefficient > 0) <> (intent > 0)")


def impossible(cells: DataFrame, least: int = 20) -> DataFrame:
    """Rows of (name, value, n) whose value is exactly 0 or 1 though n is at least ``least``: each needs an explanation."""
    return cells.where((F.col("n") >= least) & F.col("value").isin(0.0, 1.0))


def lineage(fields: DataFrame, edges: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """(field, declared, effective, denied): the most interpretive class among a field and all it depends on, and whether any of these is denied by name.

    ``fields`` has field and declared, ``edges`` field and depends_on, ``denied`` field. Fields are settled from those that depend on
    nothing upwards, one written table a level, so closures are never listed. An unknown class, a dependency that is no field,
    and a cycle each stop the job.
    """
    scratch = Scratch(fields.sparkSession, "lineage")
    names = F.array(*[F.lit(e) for e in EVIDENCE])
    rank = F.array_position(names, F.col("declared")).cast("int")
    marked = fields.join(denied.select("field", F.lit(True).alias("denied")).distinct(), "field", "left") if denied is not None else fields.withColumn("denied", F.lit(False))
    own = stop(marked.select("field", rank.alias("rank"), F.coalesce("denied", F.lit(False)).alias("denied")), ~(F.col("rank") > 0), "a field has no known class")
    known = edges.join(fields.select(F.col("field").alias("depends_on"), F.lit(1).alias("is_field")).distinct(), "depends_on", "left")
    wait = scratch.cut(stop(known, F.col("is_field").isNull(), "a field depends on what is no field").select("field", "depends_on").distinct(), "edges")
    open_ = scratch.cut(own, "own")
    settled, level = [], 0
    while True:
        free = scratch.cut(open_.join(wait.select("field").distinct(), "field", "left_anti"), f"free{level}")
        if free.isEmpty():
            break
        settled.append(free)
        # what the settled ones bring to those above
        given = wait.join(free.select(F.col("field").alias("depends_on"), F.col("rank").alias("r"), F.col("denied").alias("d")), "depends_on").groupBy("field").agg(F.max("r").alias("r"), F.max("d").alias("d"))
        rest = open_.join(free.select("field"), "field", "left_anti").join(given, "field", "left")
        open_ = scratch.cut(rest.select("field", F.greatest("rank", F.coalesce("r", "rank")).alias("rank"), (F.col("denied") | F.coalesce("d", F.lit(False))).alias("denied")), f"open{level}")
        wait = scratch.cut(wait.join(free.select(F.col("field").alias("depends_on")), "depends_on", "left_anti"), f"edges{level}")
        level += 1
    if not open_.isEmpty():
        raise ValueError("fields depend on each other in a cycle")
    if not settled:
        return fields.select("field", "declared", F.col("declared").alias("effective"), F.lit(False).alias("denied")).limit(0)
    every = reduce(DataFrame.unionByName, settled)
    return fields.select("field", "declared").join(every, "field").select("field", "declared", F.element_at(names, F.col("rank")).alias("effective"), "denied")


def policy_verdict(effective: Column, denied: Column, policy: str, semantic: bool = False) -> Column:
    """What a policy says of a requested field, the first that holds: unknown, denied lineage, class not admitted, technical (as a feature of a model), admitted."""
    out = F.when(effective.isNull(), "unknown_field").when(denied, "denied_lineage").when(~effective.isin(*POLICIES[policy]), "class_not_admitted")
    if semantic:
        out = out.when(effective == "SYSTEM_TECHNICAL", "technical_as_feature")
    return out.otherwise("admitted")


def partition_faults(whole: DataFrame, parts: DataFrame, key: str, part: str) -> DataFrame:
    """(missing, foreign, in_several): how far ``parts`` is no disjoint and complete partition of ``whole``."""
    a = whole.select(key).where(F.col(key).isNotNull()).distinct().withColumn("w", F.lit(1))
    b = parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
    met = a.join(b.withColumn("p", F.lit(1)), key, "full")
    return met.agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("foreign"), F.count_if(F.col("lo") != F.col("hi")).alias("in_several"))
