"""The join retrieval suite: tiers of linked fragments by index variant, with exclusive text, and failures against hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import retrieval as ret
from ..operators import sampling as sm
from ..operators import text
from ..sources.tables import table
from ..storage import Scratch
from . import retrieval as rp
from .audit import _F as _FRAGS
from .quality import _ONE, _labels

TIERS = ("A", "B", "C")


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, parent, tokens, family, test): fragments, written; equal renderings are a family."""
    frags = text.fragments(table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering")).withColumnRenamed("fragment_id", "doc_id")
    frags = frags.withColumn("text", F.array_join("tokens", " "))
    fam = text.families(frags)
    lab = _labels(spark, sf).where("label = 'test'").select(F.col("doc_id").alias("parent"), F.lit(True).alias("test"))
    one = frags.drop("text").join(fam, "doc_id").join(lab, "parent", "left").withColumn("test", F.coalesce("test", F.lit(False)))
    return Scratch(spark, "suite").cut(one, "fragments")


def _positives(spark: SparkSession, sf: str) -> DataFrame:
    """(tier, query_id, doc_id): partners of the test side in both directions, of each tier and of all (pooled)."""
    pairs = table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b", "tier", "test_side").where("test_side and tier is not null")
    per = [sm.adjacency(pairs.where(F.col("tier") == t), "fragment_id_a", "fragment_id_b").withColumn("tier", F.lit(t)) for t in TIERS]
    pooled = sm.adjacency(pairs, "fragment_id_a", "fragment_id_b").withColumn("tier", F.lit("pooled"))
    return reduce(DataFrame.unionByName, [*per, pooled]).select("tier", F.col("id").alias("query_id"), F.col("partner").alias("doc_id"))


def _exclusive(frags: DataFrame, positives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments with the text they have to themselves against their least partner of tier C, and the pairs this makes; pairs that leave a side bare are left out."""
    known = frags.select("doc_id", "tokens")
    least = positives.where("tier = 'C'").join(known.select("doc_id"), "doc_id", "left_semi").groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    met = least.join(known.select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("q")), "query_id").join(known.withColumnRenamed("tokens", "d"), "doc_id")
    own = met.select("query_id", "doc_id", F.filter("q", lambda t: ~F.array_contains("d", t)).alias("own"), F.filter("d", lambda t: ~F.array_contains("q", t)).alias("theirs")).where((F.size("own") > 0) & (F.size("theirs") > 0))
    cut = own.select(F.col("query_id").alias("doc_id"), "own")
    index = frags.join(cut, "doc_id", "left").withColumn("tokens", F.coalesce("own", "tokens")).drop("own")
    return index, own.select(F.lit("C_exclusive").alias("tier"), "query_id", "doc_id")


def _search(index: DataFrame, queries: DataFrame, families: bool) -> ranks.Search:
    """Every query against all fragments but itself and, where asked, fragments of other tablets with its text: members of one tablet stay."""
    barred = [F.col("doc_id").alias("b"), *([F.col("family").alias("a"), F.col("parent").alias("spare")] if families else [])]
    return ranks.Search(index.select("doc_id", "tokens", *barred), queries.select(F.col("doc_id").alias("query_id"), "tokens", *barred))


def _measured(positives: DataFrame, queries: DataFrame, search: ranks.Search) -> DataFrame:
    """(tier, query_id, rank): rank of the first partner, null where none is a candidate; queries have a text."""
    asked = search.scratch.cut(positives.join(queries.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi"), "asked")
    scored = search.scored(asked).join(asked, ["query_id", "doc_id"])
    firsts = ranks.first_placed(search, scored, "tier").select("tier", "query_id", "rank")
    return asked.select("tier", "query_id").distinct().join(firsts, ["tier", "query_id"], "left")


def _suite(spark: SparkSession, sf: str) -> DataFrame:
    """(variant, tier, query_id, rank): written once for its measures."""
    frags, positives = _fragments(spark, sf), Scratch(spark, "suite").cut(_positives(spark, sf), "positives")
    queries = frags.join(positives.select(F.col("query_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    cut = Scratch(spark, "exclusive")  # short plans: each of these is read many times
    own, pairs = (cut.cut(x, name) for x, name in zip(_exclusive(frags, positives), ("index", "pairs")))
    queries, asked = cut.cut(queries, "queries"), cut.cut(own.join(pairs.select(F.col("query_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "asked")
    parts = []
    for variant in ("test_only", "full_distractor"):
        index, own_index = (x.where("test") if variant == "test_only" else x for x in (frags, own))
        for m in (_measured(positives, queries, _search(index, queries, True)), _measured(pairs, asked, _search(own_index, asked, False))):
            parts.append(cut.cut(m.select(F.lit(variant).alias("variant"), "tier", "query_id", "rank"), f"firsts{len(parts)}"))
    return Scratch(spark, "suite").cut(reduce(DataFrame.unionByName, parts), "firsts")


def task_b_suite(spark: SparkSession, sf: str) -> DataFrame:
    hit = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 5, 10)]
    mrr = F.round(F.avg(F.when(F.col("rank").isNotNull(), 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    return _suite(spark, sf).groupBy("variant", "tier").agg(F.count(F.lit(1)).alias("queries"), *hit, mrr)


def task_b_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap intervals of the pooled recall at each cutoff, all documents as candidates."""
    cut = Scratch(spark, "intervals")
    frags, positives = _fragments(spark, sf), cut.cut(_positives(spark, sf).where("tier = 'pooled'"), "positives")  # every query has a pooled partner
    queries = cut.cut(frags.join(positives.select(F.col("query_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "queries")
    firsts = cut.cut(_measured(positives, queries, _search(frags, queries, True)), "firsts")
    out = None
    for k in (1, 10):
        ci = ret.bootstrap(firsts.select(F.col("query_id").alias("key"), F.when(F.col("rank") <= k, 1.0).otherwise(0.0).alias("hit")), "hit").select(F.lit(k).alias("k"), "*")
        out = ci if out is None else out.unionByName(ci)
    return out


def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Queries answered in the first ten against those missed, by hundred of composition: how many, how long they are, how well the best partner scores."""
    docs = rp._docs(spark, sf, attested=True)
    search = rp._search(docs)
    first = search.first_of_group()
    best = search.placed(first).select("query_id", "rank").join(first.select("query_id", F.col("top").alias("score")), "query_id")
    q = rp._answerable(docs).join(docs.select(F.col("doc_id").alias("query_id"), "cth", F.size("attested").alias("n")), "query_id").join(best, "query_id", "left")
    g = q.groupBy(F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("hit"), (F.floor(F.col("cth") / 100) * 100).cast("int").alias("genre"))
    return g.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("n"), 6).alias("mean_attested"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean_score"))


def _sql_run(tag: str, index: str, queries: str, families: bool) -> str:
    where = "AND (d.family <> q.family OR d.parent = q.parent)" if families else ""
    return f"""
p{tag} AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM {index}) GROUP BY ALL),
i{tag} AS (SELECT term, greatest(ln((nd - df + 0.5) / (df + 0.5) + 1.0), 0.0) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM p{tag} GROUP BY term), (SELECT count(*) AS nd, avg(len(t)) AS avgdl FROM {index})),
s{tag} AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) AS score FROM (SELECT doc_id AS query_id, unnest(list_distinct(t)) AS term FROM {queries}) JOIN i{tag} USING (term) JOIN p{tag} USING (term) WHERE idf > 0 AND query_id <> doc_id GROUP BY ALL),
r{tag} AS (SELECT query_id, s.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, s.doc_id) AS rank FROM s{tag} s JOIN {index} d ON d.doc_id = s.doc_id JOIN {queries} q ON q.doc_id = query_id WHERE true {where})"""


_SUITE = f"""WITH {_ONE}, {_FRAGS},
fa AS (SELECT id AS doc_id, parent, t, min(id) OVER (PARTITION BY array_to_string(t, ' ')) AS family, coalesce(label = 'test', false) AS test FROM fg LEFT JOIN one ON one.doc_id = fg.parent),
jp AS (SELECT fragment_id_a AS a, fragment_id_b AS b, tier FROM join_pairs WHERE test_side AND tier IS NOT NULL AND fragment_id_a <> fragment_id_b),
po AS (SELECT tier, a AS query_id, b AS doc_id FROM jp UNION SELECT tier, b, a FROM jp UNION SELECT 'pooled', a, b FROM jp UNION SELECT 'pooled', b, a FROM jp),
qu AS (SELECT * FROM fa WHERE doc_id IN (SELECT query_id FROM po)),
lp AS (SELECT query_id, min(doc_id) AS doc_id FROM po WHERE tier = 'C' AND doc_id IN (SELECT doc_id FROM fa) GROUP BY query_id),
ex AS (SELECT * FROM (SELECT query_id, lp.doc_id, list_filter(q.t, lambda z: NOT list_contains(d.t, z)) AS own, list_filter(d.t, lambda z: NOT list_contains(q.t, z)) AS theirs FROM lp JOIN fa q ON q.doc_id = lp.query_id JOIN fa d ON d.doc_id = lp.doc_id) WHERE len(own) > 0 AND len(theirs) > 0),
fe AS (SELECT fa.doc_id, parent, coalesce(own, t) AS t, family, test FROM fa LEFT JOIN ex ON ex.query_id = fa.doc_id),
qe AS (SELECT * FROM fe WHERE doc_id IN (SELECT query_id FROM ex)),
ft AS (SELECT * FROM fa WHERE test), fet AS (SELECT * FROM fe WHERE test),
{_sql_run('1', 'ft', 'qu', True)}, {_sql_run('2', 'fet', 'qe', False)}, {_sql_run('3', 'fa', 'qu', True)}, {_sql_run('4', 'fe', 'qe', False)},
fi AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variant, tier, query_id, min(rank) AS rank FROM (SELECT tier, query_id, doc_id FROM po WHERE query_id IN (SELECT doc_id FROM qu)) LEFT JOIN r{a} USING (query_id, doc_id) GROUP BY ALL"
    f" UNION ALL SELECT '{v}', 'C_exclusive', query_id, min(rank) FROM ex LEFT JOIN r{b} USING (query_id, doc_id) GROUP BY ALL" for v, a, b in (("test_only", 1, 2), ("full_distractor", 3, 4))) + ")"

QUERIES = {f.__name__: f for f in (task_b_suite, task_b_intervals, failure_taxonomy)}
SQL = {
    "task_b_suite": f"{_SUITE} SELECT variant, tier, count(*) AS queries, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 5, 10)) + ", round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr FROM fi GROUP BY ALL",
    "failure_taxonomy": f"WITH {rp._BASE}, {rp._sql_bm25()}, {rp._ANS}, b AS (SELECT query_id, min(rank) AS rank, max(score) AS score FROM jd WHERE positive GROUP BY query_id) "
                        "SELECT coalesce(rank <= 10, false) AS hit, CAST(floor(cth / 100.0) * 100 AS INTEGER) AS genre, count(*) AS queries, round(avg(len(attested)), 6) AS mean_attested, round(avg(coalesce(score, 0.0)), 6) AS mean_score "
                        "FROM ans JOIN docs ON docs.doc_id = ans.query_id LEFT JOIN b ON b.query_id = ans.query_id GROUP BY ALL",
}
