"""Queries of contracts, policy, provenance and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, text
from ..operators import calibration as cal
from ..operators import contracts as ct
from ..sources.tables import table
from .audit import _F as _FRAGS
from .audit import _L as _LABELS


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label): the one label of a tablet; null where it has none or several."""
    lab = table(spark, sf, "splits", "doc_id", "main_split").select("doc_id", audit.clean_label(F.col("main_split")).alias("label")).where("doc_id is not null")
    return lab.groupBy("doc_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).select("doc_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"))


def read_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Tablets of the log by whether training may read them."""
    ids = table(spark, sf, "failures", "doc_id").where("doc_id is not null")
    return ct.guard(ids, _labels(spark, sf), "doc_id").groupBy("breach").agg(F.count(F.lit(1)).alias("tablets"))


def truth_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """Tablets of logged fragments that no row of ``splits`` with a label of train, dev or test can bring, those of discovery being declared so."""
    log = table(spark, sf, "failures", "query_id").where("query_id is not null").select(F.col("query_id").alias("query"), text.parent(F.col("query_id")).alias("gold")).distinct()
    lab = _labels(spark, sf)
    candidates = lab.where("label in ('train', 'dev', 'test')").select(F.col("doc_id").alias("gold"))
    declared = log.join(lab.where("label = 'discovery'").select(F.col("doc_id").alias("gold")), "gold", "left_semi").select("query", "gold")
    return ct.unreachable(log, candidates, declared)


def both_sides_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Logged pairs by whether both sides have lengths to compare and tokens that tell something."""
    log = table(spark, sf, "failures", "query_rendering", "predicted_rendering", "kind")
    q, p = text.tokens(F.regexp_replace("query_rendering", "\n", " ")), text.tokens(F.regexp_replace("predicted_rendering", "\n", " "))
    both = ct.lexical(q, ("x", "<NUM>")) & ct.lexical(p, ("x", "<NUM>"))
    return log.groupBy("kind", both.alias("lexical"), ct.parallel(q, p).alias("equal_length")).agg(F.count(F.lit(1)).alias("pairs"))


def universe_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the universes that statistics are fitted on, per label of the tablet; the content digest is tested apart."""
    frags = text.fragments(table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering"))
    lab = _labels(spark, sf).select(F.col("doc_id").alias("parent"), "label")
    out = None
    for u in ("train", "dev"):
        one = ct.stamp(frags.join(lab.where(F.col("label") == u), "parent", "left_semi"), u, "fragment_id", "tokens").select("universe", "n")
        out = one if out is None else out.unionByName(one)
    return out


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def feature_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem", *FEATURES).withColumn("constant", F.lit(1.0))
    return ct.feature_health(rows, [*FEATURES, "constant"])


def impossible_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of exactly none or all per ship mode and status in at least twenty rows."""
    cells = table(spark, sf, "lineitem", "l_linestatus", "l_returnflag").groupBy(F.concat_ws("/", "l_linestatus", "l_returnflag").alias("name")).agg(
        F.avg((F.col("l_linestatus") == "F").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    return ct.impossible(cells)


def coefficient_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Features of order lines whose correlation with the price runs against the sign it was meant to have."""
    names = ["l_quantity", "l_discount", "l_tax"]
    one = table(spark, sf, "lineitem", *FEATURES).agg(*[F.round(F.corr(n, "l_extendedprice"), 6).alias(n) for n in names])
    intent = {"l_quantity": -1, "l_discount": None, "l_tax": 0}
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("coefficient"), F.lit(intent[n]).cast("int").alias("intent")) for n in names])).alias("x")).select("x.*")
    return ct.against_intent(rows.where("intent is null or intent <> 0"))


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, customers, nations and regions as fields, each derived from the next; their classes follow their keys. Two regions are denied by name."""
    def cls(key: str):
        return F.element_at(F.array(*[F.lit(c) for c in ct.EVIDENCE]), (F.col(key) % 5 + 1).cast("int"))

    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    name = {"o": "o_orderkey", "c": "c_custkey", "n": "n_nationkey", "r": "r_regionkey"}
    fields, edges = None, None
    for part, df in (("o", o), ("c", c), ("n", n), ("r", r)):
        f = df.select(F.concat(F.lit(part), F.col(name[part]).cast("string")).alias("field"), cls(name[part]).alias("declared"))
        fields = f if fields is None else fields.unionByName(f)
    for part, df, up, key in (("o", o, "c", "o_custkey"), ("c", c, "n", "c_nationkey"), ("n", n, "r", "n_regionkey")):
        e = df.select(F.concat(F.lit(part), F.col(name[part]).cast("string")).alias("field"), F.concat(F.lit(up), F.col(key).cast("string")).alias("depends_on"))
        edges = e if edges is None else edges.unionByName(e)
    return fields, edges, r.where("r_regionkey >= 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("field"))


def evidence_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return ct.lineage(*_registry(spark, sf))


def policy_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Fields by verdict of each named policy, as requested fields and as features of a model."""
    told = evidence_lineage(spark, sf)
    every = None
    for p in ct.POLICIES:
        for s in (False, True):
            v = told.groupBy(F.lit(p).alias("policy"), F.lit(s).alias("semantic"), ct.policy_verdict(F.col("effective"), F.col("denied"), p, s).alias("verdict")).agg(F.count(F.lit(1)).alias("fields"))
            every = v if every is None else every.unionByName(v)
    return every


def fold_partition(spark: SparkSession, sf: str) -> DataFrame:
    """That greedy folds hold each composition once."""
    rows = table(spark, sf, "splits", "doc_id", "cth").where("cth is not null")
    weights = rows.groupBy("cth").agg(F.count(F.lit(1)).alias("n"))
    return ct.partition_faults(rows, cal.greedy_folds(weights, "cth", "n", 5), "cth", "fold")


_ONE = f"{_LABELS}, one AS (SELECT doc_id, CASE WHEN min(label) = max(label) THEN min(label) END AS label FROM lab WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_TK = "list_filter(string_split_regex({c}, '[ \t\r\n]+'), lambda z: z <> '')"
_CLS = "[" + ", ".join(f"'{c}'" for c in ct.EVIDENCE) + "]"
_LINEAGE = f"""WITH RECURSIVE f AS (SELECT 'o' || o_orderkey AS field, {_CLS}[o_orderkey % 5 + 1] AS declared FROM orders UNION ALL SELECT 'c' || c_custkey, {_CLS}[c_custkey % 5 + 1] FROM customer
        UNION ALL SELECT 'n' || n_nationkey, {_CLS}[n_nationkey % 5 + 1] FROM nation UNION ALL SELECT 'r' || r_regionkey, {_CLS}[r_regionkey % 5 + 1] FROM region),
    e AS (SELECT 'o' || o_orderkey AS field, 'c' || o_custkey AS dep FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    r AS (SELECT field, field AS dep FROM f UNION SELECT r.field, e.dep FROM r JOIN e ON e.field = r.dep),
    lin AS (SELECT f.field, f.declared, {_CLS}[max(list_position({_CLS}, g.declared))] AS effective, bool_or(r.dep IN ('r3', 'r4')) AS denied FROM f JOIN r ON r.field = f.field JOIN f g ON g.field = r.dep GROUP BY f.field, f.declared)"""


def _sql_policy() -> str:
    parts = []
    for p, allowed in ct.POLICIES.items():
        for s in (False, True):
            technical = "WHEN effective = 'SYSTEM_TECHNICAL' THEN 'technical_as_feature' " if s else ""
            parts.append(f"SELECT '{p}' AS policy, {str(s).lower()} AS semantic, CASE WHEN denied THEN 'denied_lineage' WHEN effective NOT IN ({', '.join(repr(a) for a in allowed)}) THEN 'class_not_admitted' {technical}ELSE 'admitted' END AS verdict, count(*) AS fields FROM lin GROUP BY ALL")
    return f"{_LINEAGE} " + " UNION ALL ".join(parts)


QUERIES = {f.__name__: f for f in (
    read_guard, truth_reachable, both_sides_lexical, universe_stamps, feature_health, impossible_cells, coefficient_intent, evidence_lineage, policy_verdicts, fold_partition)}

SQL = {
    "read_guard": f"WITH {_ONE} SELECT CASE WHEN label IS NULL THEN 'missing' WHEN label NOT IN ('train', 'dev', 'test', 'discovery') THEN 'unknown_split' WHEN label = 'test' THEN 'test' END AS breach, count(*) AS tablets FROM (SELECT DISTINCT doc_id FROM failures WHERE doc_id IS NOT NULL) LEFT JOIN one USING (doc_id) GROUP BY 1",
    "truth_reachable": f"WITH {_ONE} SELECT DISTINCT query_id AS query, string_split(query_id, '::')[1] AS gold FROM failures LEFT JOIN one ON one.doc_id = string_split(query_id, '::')[1] WHERE query_id IS NOT NULL AND (label IS NULL OR label NOT IN ('train', 'dev', 'test', 'discovery'))",
    "both_sides_lexical": f"WITH t AS (SELECT kind, coalesce({_TK.format(c='query_rendering')}, []::VARCHAR[]) AS q, coalesce({_TK.format(c='predicted_rendering')}, []::VARCHAR[]) AS p FROM failures) "
                          "SELECT kind, len(list_filter(q, lambda z: z NOT IN ('x', '<NUM>'))) > 0 AND len(list_filter(p, lambda z: z NOT IN ('x', '<NUM>'))) > 0 AS lexical, len(q) = len(p) AS equal_length, count(*) AS pairs FROM t GROUP BY ALL",
    "universe_stamps": f"WITH {_ONE}, {_FRAGS} SELECT label AS universe, count(*) AS n FROM fg JOIN one ON one.doc_id = fg.parent WHERE label IN ('train', 'dev') GROUP BY label",
    "feature_health": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) AS n, 0::BIGINT AS not_finite, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, var_pop(v) < 1e-6 AS degenerate FROM (SELECT CAST({e} AS DOUBLE) AS v FROM lineitem)"
        for f, e in [*((x, x) for x in FEATURES), ("constant", "1.0")]),
    "impossible_cells": "SELECT * FROM (SELECT l_linestatus || '/' || l_returnflag AS name, avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) AS value, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 20 AND value IN (0.0, 1.0)",
    "coefficient_intent": "SELECT * FROM (SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS coefficient, -1 AS intent FROM lineitem) WHERE coefficient > 0",
    "evidence_lineage": f"{_LINEAGE} SELECT * FROM lin",
    "policy_verdicts": _sql_policy(),
    "fold_partition": "SELECT 0::BIGINT AS missing, 0::BIGINT AS foreign, 0::BIGINT AS in_several".replace("AS foreign", 'AS "foreign"'),
}
