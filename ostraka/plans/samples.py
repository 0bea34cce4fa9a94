"""Queries of composites and edges, samples, splits by strata, taxonomies, tests and witnesses of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import fisher_exact
from ..operators import audit, text, thirds
from ..operators import composites as co
from ..operators import sampling as sm
from ..operators import structure as st
from ..sources.tables import spread, table
from .audit import _F as _FRAGS
from .structure import _ST, _words


def _composites(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as composites: line numbers are members, side by side in their order; months are lines, quantities signs."""
    rows = table(spark, sf, "lineitem", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity").select(
        F.col("l_partkey").alias("parent"), F.col("l_linenumber").alias("member"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("line"), F.col("l_quantity").cast("double").alias("q"))
    lines = rows.groupBy("parent", "line", "member").agg(F.sum("q").alias("signs"))
    members = lines.select("parent", "member").distinct()
    return members.withColumn("ord", F.row_number().over(Window.partitionBy("parent").orderBy("member"))), lines


def composite_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = co.member_pairs(*_composites(spark, sf))
    return pairs.groupBy("geometry", "declared").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_shared").alias("shared"))


def join_tiers(spark: SparkSession, sf: str) -> DataFrame:
    members, lines = _composites(spark, sf)
    t = co.tiered(co.member_pairs(members, lines), lines)
    return t.groupBy("tier", "layout", "untestable").agg(
        F.count(F.lit(1)).alias("pairs"), *[F.sum(c).alias(c) for c in ("lines_a", "lines_b", "signs_a", "signs_b")])


def edge_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of documents: a line of worn or restored words only is a gap, a primed number tells a break, ``o. Rd.`` and ``u. Rd.`` name edges."""
    w = st.milestone_states(_words(spark, sf))
    lost = F.col("state").isin("illegible_x", "restored")
    lines = w.groupBy("doc_id", "line").agg(
        F.min(lost.cast("int")).alias("g"), F.min_by("word", "pos").alias("w1"), F.min_by("state", "pos").alias("first"), F.max_by("state", "pos").alias("last"),
        F.max(F.when(F.col("word") == "Rd.", 1).otherwise(0)).alias("rd"), F.max(F.when(F.col("word") == "o.", 1).otherwise(0)).alias("o"))
    edge = F.when((F.col("rd") == 1) & (F.col("o") == 1), "upper").when(F.col("rd") == 1, "lower")
    prof = co.edge_profile(lines.select("doc_id", "line", (F.col("g") == 1).alias("gap"), F.col("w1").endswith("′").alias("prime"), edge.alias("edge"), "first", "last"), "doc_id")
    return prof.groupBy("top_lost", "bottom_lost", "first_state", "last_state").agg(F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("lines"))


def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty orders of each priority, one of each customer first."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return sm.quota(o, "o_orderpriority", "o_custkey", ["o_orderkey"], 40).select("o_orderpriority", "o_orderkey", "place")


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "splits", "doc_id", "cth").where("cth is not null").groupBy("cth").agg(F.countDistinct("doc_id").alias("n"))
    return sm.stratified(rows.withColumn("band", audit.size_band(F.col("n"))), "cth", "band", 0.8, 0.1)


def population_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Compositions up to 36, or up to 389 tablets, whichever comes first."""
    rows = table(spark, sf, "splits", "doc_id", "cth").where("cth is not null").groupBy("cth").agg(F.countDistinct("doc_id").alias("n"))
    return sm.until_enough(rows, "cth", "n", 36, 389)


def hard_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return sm.hard_quarter(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey")


def fisher_hardset(spark: SparkSession, sf: str) -> DataFrame:
    """Exact test of suppliers of the lowest quarter of balances against the rest, by half of the nations; four counts reach the driver."""
    s = table(spark, sf, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    hard = sm.hard_quarter(s, "s_acctbal").select("s_suppkey", F.lit(1).alias("h"))
    cells = s.join(hard, "s_suppkey", "left").agg(*[F.count_if((F.coalesce("h", F.lit(0)) == h) & ((F.col("s_nationkey") < 12) == n)).alias(f"c{i}") for i, (h, n) in enumerate([(1, True), (1, False), (0, True), (0, False)])])
    a, b, c, d = cells.first()
    t = fisher_exact(a, b, c, d)
    return spark.createDataFrame([(a, b, c, d, *(round(float(t[k]), 6) for k in ("odds_ratio", "two_sided", "greater", "less")))], "a long, b long, c long, d long, odds_ratio double, two_sided double, greater double, less double")


def restored_span_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Restored runs by length, and how many are of syllabic words throughout."""
    w = st.milestone_states(_words(spark, sf))
    by, of = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id", "state").orderBy("pos")
    runs = w.withColumn("g", F.row_number().over(by) - F.row_number().over(of)).where("state = 'restored'").groupBy("doc_id", "g").agg(
        F.count(F.lit(1)).alias("n"), F.min((st.word_class(F.col("word")) == "syllabic").cast("int")).alias("whole"))
    return runs.groupBy(sm.length_band(F.col("n")).alias("length")).agg(F.count(F.lit(1)).alias("runs"), F.sum("whole").alias("whole"))


def best_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order the line of the highest discount, with its flag and number, and how many lines are above 0.05."""
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount").withColumn("score", F.col("l_discount").cast("double"))
    return sm.best_with_place(rows, ["l_orderkey"], "score", ["l_returnflag", "l_linenumber"], 0.05)


def transfer_gap(spark: SparkSession, sf: str) -> DataFrame:
    """How far return rates per line number and status differ between odd and even orders."""
    key = ["l_linenumber", "l_linestatus"]
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", *key)
    odd, even = (rows.where(F.col("l_orderkey") % 2 == r).groupBy(*key).agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("l_returnflag") == "A").alias("exact")) for r in (1, 0))
    return sm.transfer_gap(odd, even, key)


def partner_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = sm.adjacency(table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b"), "fragment_id_a", "fragment_id_b")
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("partners"))


def unlinked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tablets within a composition that no match result links."""
    members = table(spark, sf, "splits", "cth", "doc_id")
    known = table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b").select(text.parent(F.col("fragment_id_a")).alias("member_a"), text.parent(F.col("fragment_id_b")).alias("member_b"))
    return sm.unlinked_pairs(members, "cth", "doc_id", known)


def glyph_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Glyph rows of logged queries against the tokens of what was predicted."""
    log = spread(table(spark, sf, "failures", "query_rendering", "predicted_rendering")).where("query_rendering is not null and predicted_rendering is not null")

    def toks(c):
        return F.filter(F.split(c, "[ \t\r\n]+"), lambda t: t != "")

    glyphs = F.array_join(F.transform(toks("query_rendering"), lambda t: F.when(t == "x", F.lit("▒")).otherwise(F.lit("o"))), "")
    return log.groupBy(st.glyph_alignment(glyphs, toks("predicted_rendering")).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


WITNESS_GRAMS = (3, 5)


def third_witness_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Linked pairs of fragments that a third fragment spans: it holds a run of one and, apart from it, a run of the other.

    Of all places where a witness meets a fragment the first and the last decide whether two places lie apart.
    """
    frags = text.fragments(table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering"))
    pairs = table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b", "tier").where("fragment_id_a <> fragment_id_b")
    one = pairs.groupBy(F.least("fragment_id_a", "fragment_id_b").alias("a"), F.greatest("fragment_id_a", "fragment_id_b").alias("b")).agg(F.min("tier").alias("tier"))
    return thirds.covered(frags, one, WITNESS_GRAMS).groupBy("n", "tier").agg(F.count(F.lit(1)).alias("pairs"), F.count("s").alias("covered"))


_CO = """ln AS (SELECT l_partkey AS parent, l_linenumber AS member, year(l_shipdate) * 12 + month(l_shipdate) AS line, sum(CAST(l_quantity AS DOUBLE)) AS signs FROM lineitem GROUP BY ALL),
mb AS (SELECT parent, member, row_number() OVER (PARTITION BY parent ORDER BY member) AS o FROM (SELECT DISTINCT parent, member FROM ln)),
de AS (SELECT a.parent, a.member AS ma, b.member AS mbb FROM mb a JOIN mb b ON a.parent = b.parent AND b.o = a.o + 1),
sh AS (SELECT a.parent, a.member AS ma, b.member AS mbb, count(*) AS n, min(a.line) AS lo, max(a.line) AS hi FROM ln a JOIN ln b ON a.parent = b.parent AND a.line = b.line AND a.member < b.member GROUP BY ALL),
pr AS (SELECT coalesce(de.parent, sh.parent) AS parent, coalesce(de.ma, sh.ma) AS ma, coalesce(de.mbb, sh.mbb) AS mbb, de.parent IS NOT NULL AS declared, coalesce(n, 0) AS n, lo, hi FROM de FULL JOIN sh ON de.parent = sh.parent AND de.ma = sh.ma AND de.mbb = sh.mbb)"""
_TWO = "sz AS (SELECT cth, count(DISTINCT doc_id) AS n FROM splits WHERE cth IS NOT NULL GROUP BY cth)"
_BAND = "CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END"

QUERIES = {f.__name__: f for f in (
    composite_pairs, join_tiers, edge_profiles, quota_sample, stratified_split, population_sample, hard_quarter, fisher_hardset, restored_span_bands, best_offsets, transfer_gap,
    partner_counts, unlinked_pairs, glyph_rows, third_witness_coverage)}


def _sql_witness() -> str:
    parts = []
    for n in WITNESS_GRAMS:
        parts.append(f"""SELECT {n} AS n, tier, count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM m{n} x JOIN m{n} y ON x.w = y.w WHERE x.f = a AND y.f = b AND x.w <> b AND y.w <> a AND (x.hi - y.lo >= {n} OR y.hi - x.lo >= {n}))) AS covered FROM one GROUP BY tier""")
    ctes = "".join(f""", g{n} AS (SELECT id, p, array_to_string(t[p + 1:p + {n}], ' ') AS g FROM (SELECT id, t, unnest(range(len(t) - {n - 1})) AS p FROM fg WHERE len(t) >= {n})),
        m{n} AS (SELECT o.id AS f, w.id AS w, min(w.p) AS lo, max(w.p) AS hi FROM (SELECT DISTINCT id, g FROM g{n} WHERE id IN (SELECT a FROM one UNION SELECT b FROM one)) o JOIN g{n} w ON w.g = o.g AND w.id <> o.id GROUP BY ALL)""" for n in WITNESS_GRAMS)
    return f"""WITH {_FRAGS}, one AS (SELECT least(fragment_id_a, fragment_id_b) AS a, greatest(fragment_id_a, fragment_id_b) AS b, min(tier) AS tier FROM join_pairs WHERE fragment_id_a <> fragment_id_b
            AND fragment_id_a IN (SELECT id FROM fg) AND fragment_id_b IN (SELECT id FROM fg) GROUP BY 1, 2){ctes} """ + " UNION ALL ".join(parts)


SQL = {
    "composite_pairs": f"WITH {_CO} SELECT CASE WHEN n = 0 THEN 'no_overlap_seam' WHEN n <= 2 THEN 'seam_single_line_transition' WHEN hi - lo + 1 <= n + 2 THEN 'extended_overlap_duplicate_like' ELSE 'unclear' END AS geometry, declared, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS shared FROM pr GROUP BY ALL",
    "join_tiers": f"""WITH {_CO}, ex AS (SELECT p.parent, p.ma, p.mbb, x.member, x.signs FROM pr p JOIN ln x ON x.parent = p.parent AND x.member IN (p.ma, p.mbb)
            WHERE p.n > 2 AND NOT EXISTS (SELECT 1 FROM ln y WHERE y.parent = x.parent AND y.line = x.line AND y.member <> x.member AND y.member IN (p.ma, p.mbb))),
        e AS (SELECT parent, ma, mbb, count(*) FILTER (member = ma) AS la, count(*) FILTER (member = mbb) AS lb, coalesce(sum(signs) FILTER (member = ma), 0) AS sa, coalesce(sum(signs) FILTER (member = mbb), 0) AS sb FROM ex GROUP BY ALL),
        t AS (SELECT p.n, coalesce(la, 0) AS la, coalesce(lb, 0) AS lb, CAST(floor(coalesce(sa, 0)) AS BIGINT) AS sa, CAST(floor(coalesce(sb, 0)) AS BIGINT) AS sb FROM pr p LEFT JOIN e USING (parent, ma, mbb))
        SELECT CASE WHEN n = 0 THEN 'A' WHEN n <= 2 THEN 'B' ELSE 'C' END AS tier, CASE WHEN n > 2 THEN 'horizontal' ELSE 'vertical' END AS layout, CASE WHEN n > 2 THEN sa < 8 OR sb < 8 OR la < 2 OR lb < 2 END AS untestable, count(*) AS pairs,
        CAST(sum(CASE WHEN n > 2 THEN la END) AS BIGINT) AS lines_a, CAST(sum(CASE WHEN n > 2 THEN lb END) AS BIGINT) AS lines_b, CAST(sum(CASE WHEN n > 2 THEN sa END) AS BIGINT) AS signs_a, CAST(sum(CASE WHEN n > 2 THEN sb END) AS BIGINT) AS signs_b FROM t GROUP BY ALL""",
    "edge_profiles": f"""WITH {_ST}, l AS (SELECT doc_id, line, bool_and(state IN ('illegible_x', 'restored')) AS gap, ends_with(arg_min(word, pos), '′') AS prime, arg_min(state, pos) AS f, arg_max(state, pos) AS z, bool_or(word = 'Rd.') AS rd, bool_or(word = 'o.') AS o FROM ws GROUP BY ALL),
        e AS (SELECT doc_id, count(*) FILTER (NOT gap) AS lines, min(line) FILTER (NOT gap) AS lo, max(line) FILTER (NOT gap) AS hi, min(line) FILTER (gap) AS glo, max(line) FILTER (gap) AS ghi, bool_or(rd AND o) AS up, bool_or(rd AND NOT o) AS down,
            arg_min(prime, line) FILTER (NOT gap) AS prime, arg_min(f, line) FILTER (NOT gap) AS first_state, arg_max(z, line) FILTER (NOT gap) AS last_state FROM l GROUP BY doc_id HAVING count(*) FILTER (NOT gap) > 0)
        SELECT NOT up AND (coalesce(glo < lo, false) OR prime) AS top_lost, NOT down AND coalesce(ghi > hi, false) AS bottom_lost, first_state, last_state, count(*) AS documents, CAST(sum(lines) AS BIGINT) AS lines FROM e GROUP BY ALL""",
    "quota_sample": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS nth FROM orders),
        k AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, o_orderkey) AS place FROM r) SELECT o_orderpriority, o_orderkey, CAST(place AS INTEGER) AS place FROM k WHERE place <= 40""",
    "stratified_split": f"""WITH {_TWO}, b AS (SELECT cth, {_BAND} AS band FROM sz), k AS (SELECT *, count(*) OVER (PARTITION BY band) AS n, row_number() OVER (PARTITION BY band ORDER BY md5(CAST(cth AS VARCHAR)), cth) AS k FROM b),
        c AS (SELECT *, CASE WHEN n >= 3 THEN least(round(n * 0.8::DOUBLE), n - 2) ELSE round(n * 0.8::DOUBLE) END AS nt, CASE WHEN n >= 3 THEN greatest(round(n * 0.1::DOUBLE), 1) ELSE round(n * 0.1::DOUBLE) END AS nd FROM k)
        SELECT band, cth, CASE WHEN k <= nt THEN 'train' WHEN k <= nt + nd THEN 'dev' ELSE 'test' END AS split FROM c""",
    "population_sample": f"WITH {_TWO}, k AS (SELECT cth, n, row_number() OVER w AS k, coalesce(sum(n) OVER (ORDER BY md5(CAST(cth AS VARCHAR)), cth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sz WINDOW w AS (ORDER BY md5(CAST(cth AS VARCHAR)), cth)) SELECT cth, n FROM k WHERE k <= 36 AND before < 389",
    "hard_quarter": "SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.25) FROM orders)",
    "fisher_hardset": """WITH t AS (SELECT s_acctbal <= (SELECT quantile_cont(s_acctbal, 0.25) FROM supplier) AS h, s_nationkey < 12 AS n FROM supplier),
        c AS (SELECT count(*) FILTER (h AND n) AS a, count(*) FILTER (h AND NOT n) AS b, count(*) FILTER (NOT h AND n) AS c, count(*) FILTER (NOT h AND NOT n) AS d FROM t),
        k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM c),
        w AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS w FROM k)
        SELECT a, b, c, d, round(a * d / CAST(b * c AS DOUBLE), 6) AS odds_ratio, round(least(1.0, sum(w) FILTER (w <= (SELECT w FROM w WHERE k = a) + 1e-12)), 6) AS two_sided, round(least(1.0, sum(w) FILTER (k >= a)), 6) AS greater, round(least(1.0, sum(w) FILTER (k <= a)), 6) AS less FROM w GROUP BY a, b, c, d""",
    "restored_span_bands": f"""WITH {_ST}, g AS (SELECT doc_id, state, regexp_replace(word, '[\\[\\]⸢⸣()]', '', 'g') AS b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, state ORDER BY pos) AS g FROM ws),
        r AS (SELECT count(*) AS n, min(CASE WHEN NOT regexp_full_match(b, '[0-9]+') AND b <> '<NUM>' AND NOT regexp_matches(b, '^\\{{[^{{}}]+\\}}') AND NOT regexp_full_match(b, '\\p{{Lu}}[\\p{{Lu}}.]+(-.*)?') AND contains(b, '-') THEN 1 ELSE 0 END) AS whole FROM g WHERE state = 'restored' GROUP BY doc_id, g)
        SELECT CASE WHEN n <= 10 THEN CAST(n AS VARCHAR) WHEN n <= 20 THEN '11-20' ELSE '>20' END AS length, count(*) AS runs, CAST(sum(whole) AS BIGINT) AS whole FROM r GROUP BY 1""",
    "best_offsets": "SELECT l_orderkey, -b.s AS best, b.f AS l_returnflag, b.n AS l_linenumber, n_above FROM (SELECT l_orderkey, min({'s': -CAST(l_discount AS DOUBLE), 'f': l_returnflag, 'n': l_linenumber}) AS b, count(*) FILTER (CAST(l_discount AS DOUBLE) > 0.05::DOUBLE) AS n_above FROM lineitem GROUP BY l_orderkey)",
    "transfer_gap": "WITH g AS (SELECT l_linenumber, l_linestatus, l_orderkey % 2 AS r, 100.0::DOUBLE * count(*) FILTER (l_returnflag = 'A') / count(*) AS p, count(*) AS w FROM lineitem GROUP BY ALL) SELECT round(sum(abs(a.p - b.p) * b.w) / sum(b.w), 6) AS gap, count(*) AS cells FROM g a JOIN g b ON a.l_linenumber = b.l_linenumber AND a.l_linestatus = b.l_linestatus AND a.r = 1 AND b.r = 0",
    "partner_counts": "WITH e AS (SELECT fragment_id_a AS id, fragment_id_b AS p FROM join_pairs UNION SELECT fragment_id_b, fragment_id_a FROM join_pairs) SELECT id, count(*) AS partners FROM e WHERE id IS NOT NULL AND p IS NOT NULL AND id <> p GROUP BY id",
    "unlinked_pairs": """WITH m AS (SELECT DISTINCT cth, doc_id FROM splits WHERE cth IS NOT NULL AND doc_id IS NOT NULL), s AS (SELECT cth, count(*) AS n FROM m GROUP BY cth),
        k AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM (SELECT string_split(fragment_id_a, '::')[1] AS a, string_split(fragment_id_b, '::')[1] AS b FROM join_pairs) WHERE a <> b),
        i AS (SELECT p.cth, count(*) AS known FROM k JOIN m p ON p.doc_id = x JOIN m q ON q.doc_id = y AND q.cth = p.cth GROUP BY p.cth)
        SELECT cth, n AS members, n * (n - 1) // 2 AS pairs, coalesce(known, 0) AS known, n * (n - 1) // 2 - coalesce(known, 0) AS "left" FROM s LEFT JOIN i USING (cth)""",
    "glyph_rows": """WITH t AS (SELECT list_filter(string_split_regex(query_rendering, '[ \t\r\n]+'), lambda z: z <> '') AS q, list_filter(string_split_regex(predicted_rendering, '[ \t\r\n]+'), lambda z: z <> '') AS p FROM failures WHERE query_rendering IS NOT NULL AND predicted_rendering IS NOT NULL),
        g AS (SELECT array_to_string(list_transform(q, lambda z: CASE WHEN z = 'x' THEN '▒' ELSE 'o' END), '') AS g, p FROM t)
        SELECT CASE WHEN length(g) = len(p) THEN 'exact' WHEN length(regexp_replace(g, '^▒+|▒+$', '', 'g')) = len(p) THEN 'edge_trim' WHEN length(replace(g, '▒', '')) = len(list_filter(p, lambda z: z <> 'x')) THEN 'skeleton_only' ELSE 'unresolved' END AS status, count(*) AS rows FROM g GROUP BY 1""",
    "third_witness_coverage": _sql_witness(),
}
