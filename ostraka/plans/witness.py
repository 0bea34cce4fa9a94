"""Queries of recoverability, rules, folds, candidate sets and horizons over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import pct, wilson
from ..operators import calibration as cal
from ..operators import passages, text, witness
from ..sources.tables import spread, table
from ..storage import Scratch

IDS = ["doc_id", "line", "start"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    fam = text.families(docs)
    named = spread(docs).select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("scope"), F.coalesce("source", F.lit("none")).alias("unit"))
    return text.lines(named, "scope", "unit").join(fam, "doc_id")


SPAN = [*witness.PAIR, "m", "family"]


def _counted(spark: SparkSession, lines: DataFrame, anchors: int = 2, masks: tuple[int, ...] = (1,), spelled: bool = False) -> DataFrame:
    """Windows counted and written: votes, levels and questions all read them."""
    w = witness.counted(lines, anchors, list(masks), "scope", "unit", spelled=spelled)
    return Scratch(spark, "windows").cut(w, "counted")


def _standings(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """(``by``, features, c): spans with any proposal, counted where they stand alike."""
    w = _counted(spark, _lines(spark, sf))
    spans = w.where("len = 1").groupBy(*SPAN, *by).agg(F.sum("c").alias("c"))
    return spans.join(witness.standings(w, [1]), SPAN)


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    return witness.eligible(_lines(spark, sf), 2, [1], "scope", "unit")


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: rules, folds and selections read the counts, never the spans again."""
    told = cal.profile(_standings(spark, sf, "unit"), "unit", weight="c")
    given = told.groupBy("unit").agg(F.sum("n").alias("told"))
    asked = _eligible(spark, sf).groupBy("unit").agg(F.sum("eligible").alias("eligible"))
    silent = asked.join(given, "unit", "left").select("unit", (F.col("eligible") - F.coalesce("told", F.lit(0))).alias("n"))
    return Scratch(spark, "profiles").cut(told.unionByName(cal.abstaining(silent, "unit")), "profiles")


def witness_census_a2m1(spark: SparkSession, sf: str) -> DataFrame:
    return witness.census(_lines(spark, sf), 2, 1, "scope", "unit")


def witness_macro(spark: SparkSession, sf: str) -> DataFrame:
    c = witness_census_a2m1(spark, sf).where("eligible > 0").withColumn("rate", F.col("supported") / F.col("eligible"))
    return c.agg(F.count(F.lit(1)).alias("units"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.percentile("rate", 0.5), 6).alias("median_rate"),
                 F.round(F.min("rate"), 6).alias("min_rate"), F.round(F.max("rate"), 6).alias("max_rate"))


def witness_census_grid(spark: SparkSession, sf: str) -> DataFrame:
    return witness.census_grid(_lines(spark, sf), [1, 2, 3], [1, 2, 3, 5], "scope", "unit")


def family_vote_standings(spark: SparkSession, sf: str) -> DataFrame:
    lines = Scratch(spark, "standings").cut(_lines(spark, sf), "lines")
    told = witness.standings(_counted(spark, lines), [1])
    s = witness.windows(lines, 2, "scope", "unit", 1).where("len = 1").join(told, SPAN)
    return s.select("doc_id", "line", "start", "n_alt", "total", "top", "runner_up", "margin", "unique_top", "top_exact", F.round("dominance", 6).alias("dominance"))


def rule_grid(spark: SparkSession, sf: str) -> DataFrame:
    return cal.evaluate(_profiles(spark, sf), cal.rules(spark))


def rule_selection(spark: SparkSession, sf: str) -> DataFrame:
    return cal.choose(cal.evaluate(_profiles(spark, sf), cal.rules(spark))).select("target", "rule_id", "accepted", "exact", "coverage", "lower")


def folds_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    weights = _eligible(spark, sf).groupBy("unit").agg(F.sum("eligible").alias("spans"))
    return cal.greedy_folds(weights, "unit", "spans", 5)


def cross_calibration(spark: SparkSession, sf: str) -> DataFrame:
    profiles = _profiles(spark, sf)
    weights = profiles.groupBy("unit").agg(F.sum("n").alias("spans"))
    folds = cal.greedy_folds(weights, "unit", "spans", 5).select("unit", "fold")
    return cal.cross_calibrate(profiles.join(folds, "unit"), cal.rules(spark))


def cross_calibration_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over three strata at once: support available, language, source."""
    told = _standings(spark, sf, "scope", "unit")
    given = told.groupBy("scope", "unit").agg(F.sum("c").alias("told"))
    asked = _eligible(spark, sf).join(given, ["scope", "unit"], "left").select("scope", "unit", (F.col("eligible") - F.coalesce("told", F.lit(0))).alias("c"))
    off = F.lit(False)
    silent = asked.where("c > 0").select("scope", "unit", F.lit(0).cast("long").alias("total"), off.alias("unique_top"), off.alias("top_exact"), "c")
    s = told.select("scope", "unit", "total", "unique_top", "top_exact", "c").unionByName(silent)
    band = F.when(F.col("total") == 0, "none").when(F.col("total") == 1, "one_family").when(F.col("total") <= 3, "two_to_three_families").otherwise("four_plus_families")
    g = s.withColumn("availability", band).groupingSets([[F.col("availability")], [F.col("scope")], [F.col("unit")]], "availability", "scope", "unit")
    return g.agg(F.sum("c").alias("spans"), F.sum(F.when(F.col("unique_top"), F.col("c")).otherwise(0)).alias("unique_tops"), F.sum(F.when(F.col("top_exact"), F.col("c")).otherwise(0)).alias("exact"))


def formulaicity(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    df = witness.formulaicity(witness.windows(lines, 2, "scope", "unit"), [1], witness.eligible_scopes(lines, "scope"))
    band = F.when(F.col("units") <= 1, "df_1").when(F.col("units") <= 5, "df_2_5").otherwise("df_6_plus")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("anchors"), F.sum("units").alias("units"))


def _candidates(spark: SparkSession, sf: str, depth: int = 5) -> DataFrame:
    """How spans with any proposal stand, with c, the number of spans alike."""
    return passages.candidate_ranks(passages.Passages(_lines(spark, sf), "scope", "unit", ordered=True), 2, [1], depth)


def candidate_set_depths(spark: SparkSession, sf: str) -> DataFrame:
    at = _candidates(spark, sf).select("n_alt", "gold_rank", "c", F.explode(F.array(*[F.lit(d) for d in (1, 2, 3, 5)])).alias("depth"))
    low, high = wilson(F.col("included"), F.col("spans"))
    included = F.sum(F.when(F.col("gold_rank") <= F.col("depth"), F.col("c")).otherwise(0))
    g = at.groupBy("depth").agg(F.sum("c").alias("spans"), included.alias("included"), F.sum(F.col("c") * F.least("depth", "n_alt")).alias("shown"))
    return g.select("depth", "spans", "included", "shown", pct(F.col("included"), F.col("spans")).alias("inclusion"), low.alias("lower"), high.alias("upper"))


def rank_calibration(spark: SparkSession, sf: str) -> DataFrame:
    r = _candidates(spark, sf).select("n_alt", "gold_rank", "c", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).where("rank <= n_alt")
    return r.groupBy("rank").agg(F.sum("c").alias("available"), F.sum(F.when(F.col("gold_rank") == F.col("rank"), F.col("c")).otherwise(0)).alias("successes"))


def disagreement_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    r = _candidates(spark, sf)
    attested = F.when(F.col("gold_rank") == 1, 1).when(F.col("gold_support") > 0, 2)
    cat = cal.disagreement(attested, F.col("top_len"), F.lit(1))

    def total(condition):
        return F.sum(F.when(condition, F.col("c")).otherwise(0))

    return r.groupBy(cat.alias("category")).agg(
        F.sum("c").alias("spans"), total(F.col("n_alt") > 1).alias("several_middles"), total(F.col("top") > 1).alias("several_families"), total(F.col("gold_support") == 0).alias("absent"))


def anchor_repeats(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    spans = witness.windows(lines, 2, "scope", "unit", 1).where("len = 1").join(witness.eligible_scopes(lines, "scope"), "scope", "left_semi")
    per = spans.groupBy("doc_id", *witness.PAIR).agg(F.count(F.lit(1)).alias("occurrences"))
    return per.groupBy("occurrences").agg(F.count(F.lit(1)).alias("anchors"))


HORIZON_MASKS = [2, 3, 4, 5]


def adaptive_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Masks 2 to 5: the longest anchors (3, 2, 1) with any proposal, shown tie-completely to depth 5."""
    known = passages.Passages(_lines(spark, sf), "scope", "unit")
    r = passages.horizon(known, [1, 2, 3], HORIZON_MASKS, 5)

    def total(condition):
        return F.sum(F.when(condition, F.col("c")).otherwise(0))

    told = r.groupBy(F.col("mask").cast("int").alias("mask")).agg(
        F.sum("c").alias("presented"), total(F.col("hit") == 1).alias("included"), total(F.col("expanded") == 1).alias("tie_expanded"), *[total(F.col("a") == a).alias(f"anchor{a}") for a in (3, 2, 1)])
    asked = witness.eligible(known.lines, 1, HORIZON_MASKS, "scope", "unit").groupBy("mask").agg(F.sum("eligible").alias("eligible"))
    g = asked.join(told, "mask", "left").na.fill(0).select("mask", "eligible", "presented", "included", "tie_expanded", "anchor3", "anchor2", "anchor1")
    return g.select("*", pct(F.col("presented"), F.col("eligible")).alias("coverage"), pct(F.col("included"), F.col("eligible")).alias("effective"))


def _sql_spans(a: int, m: int, tag: str = "") -> str:
    w = 2 * a + m
    return f"""
span{tag} AS (SELECT doc_id, scope, unit, family, line, i - 1 + {a} AS start, array_to_string(t[i:i + {a - 1}], chr(31)) AS l,
        array_to_string(t[i + {a + m}:i + {w - 1}], chr(31)) AS r, array_to_string(t[i + {a}:i + {a + m - 1}], chr(31)) AS gold
    FROM (SELECT *, unnest(range(1, len(t) - {w - 2})) AS i FROM ln WHERE len(t) >= {w}) WHERE scope IN (SELECT scope FROM ok)),
win{tag} AS (SELECT scope, family, l, array_to_string(t[i + {a} + m:i + {2 * a - 1} + m], chr(31)) AS r, array_to_string(t[i + {a}:i + {a - 1} + m], chr(31)) AS middle
    FROM (SELECT scope, family, t, i, array_to_string(t[i:i + {a - 1}], chr(31)) AS l, unnest(range(0, least(13, len(t) - i - {2 * a} + 2))) AS m
          FROM (SELECT *, unnest(range(1, len(t) - {2 * a - 2})) AS i FROM ln WHERE len(t) >= {2 * a}))),
idx{tag} AS (SELECT DISTINCT scope, l, r, middle, family FROM win{tag} SEMI JOIN span{tag} USING (scope, l, r)),
vote{tag} AS (SELECT doc_id, line, start, middle, count(*) AS support FROM span{tag} s JOIN idx{tag} w USING (scope, l, r) WHERE w.family <> s.family GROUP BY ALL)"""


_LINES = """
docs AS (SELECT doc_id, text, coalesce(lang, 'none') AS scope, coalesce(source, 'none') AS unit, min(doc_id) OVER (PARTITION BY text) AS family FROM documents WHERE text IS NOT NULL),
cutl AS (SELECT doc_id, scope, unit, family, unnest(range(len(s))) AS line, unnest(s) AS x FROM (SELECT *, string_split(text, chr(10)) AS s FROM docs)),
ln AS (SELECT doc_id, scope, unit, family, line, list_filter(string_split_regex(x, '[ \t\r]+'), lambda z: z <> '') AS t FROM cutl WHERE len(list_filter(string_split_regex(x, '[ \t\r]+'), lambda z: z <> '')) > 0),
ok AS (SELECT scope FROM ln GROUP BY scope HAVING min(family) <> max(family))"""

_STAND = f"""WITH {_LINES}, {_sql_spans(2, 1)},
one AS (SELECT doc_id, line, start, count(*) AS n_alt, sum(support) AS total, max(support) AS top, coalesce(list_sort(list(support), 'DESC')[2], 0) AS runner_up,
        coalesce(max(CASE WHEN middle = gold THEN support END), 0) AS gold_support FROM vote JOIN span USING (doc_id, line, start) GROUP BY ALL),
st AS (SELECT doc_id, line, start, scope, unit, coalesce(n_alt, 0) AS n_alt, coalesce(total, 0) AS total, coalesce(top, 0) AS top, coalesce(runner_up, 0) AS runner_up,
        coalesce(gold_support, 0) AS gold_support, coalesce(top, 0) - coalesce(runner_up, 0) AS margin, coalesce(n_alt > 0 AND top > runner_up, false) AS unique_top,
        coalesce(top / CAST(total AS DOUBLE), 0.0) AS dominance, coalesce(n_alt > 0 AND top > runner_up AND gold_support = top, false) AS top_exact
       FROM span LEFT JOIN one USING (doc_id, line, start))"""

_Z = "1.959963984540054"


def _sql_wilson(h: str, n: str) -> tuple[str, str]:
    p, c = f"(CAST({h} AS DOUBLE) / {n})", f"({_Z} * {_Z} / {n})"
    half = f"(sqrt({p} * (1 - {p}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n})) * {_Z})"
    return (f"CASE WHEN {n} > 0 THEN round(greatest(0.0, ({p} + {c} / 2 - {half}) / (1 + {c})), 6) END",
            f"CASE WHEN {n} > 0 THEN round(least(1.0, ({p} + {c} / 2 + {half}) / (1 + {c})), 6) END")


def _sql_pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN round(100.0 * {n} / CAST({d} AS DOUBLE), 2) END"


_LOW, _HIGH = _sql_wilson("exact", "accepted")
_RULES = """
rule AS (SELECT 's' || s || '_m' || m || '_d' || d.n || '_a' || coalesce(CAST(a.v AS VARCHAR), 'any') AS rule_id, s, m, d.v AS d, a.v AS a
    FROM unnest([1, 2, 3, 4]) x(s), unnest([1, 2, 3]) y(m), (VALUES ('0p0', 0.0::DOUBLE), ('0p5', 0.5), ('0p67', 0.67), ('0p8', 0.8), ('1p0', 1.0)) d(n, v), (VALUES (1), (2), (4), (8), (NULL)) a(v)),
prof AS (SELECT unit, top, margin, dominance, n_alt, unique_top, top_exact, count(*) AS n FROM st GROUP BY ALL)"""
_ACC = "unique_top AND top >= s AND margin >= m AND dominance >= d AND (a IS NULL OR n_alt <= a)"
_EVAL = f"""{_RULES},
ev AS (SELECT rule_id, CAST(sum(n) AS BIGINT) AS eligible, CAST(sum(CASE WHEN {_ACC} THEN n ELSE 0 END) AS BIGINT) AS accepted,
        CAST(sum(CASE WHEN {_ACC} AND top_exact THEN n ELSE 0 END) AS BIGINT) AS exact FROM prof, rule GROUP BY rule_id),
evw AS (SELECT *, {_sql_pct('accepted', 'eligible')} AS coverage, {_LOW} AS lower, {_HIGH} AS upper FROM ev)"""
_CENSUS = """SELECT unit, count(*) AS eligible, count(n) AS supported, count(*) FILTER (exact = 1) AS exact, count(*) FILTER (n > 0 AND exact = 0) AS variant_only,
    count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS abstained
    FROM span{tag} LEFT JOIN (SELECT doc_id, line, start, count(*) AS n, max(CASE WHEN middle = gold THEN 1 ELSE 0 END) AS exact
        FROM vote{tag} JOIN span{tag} USING (doc_id, line, start) GROUP BY ALL) USING (doc_id, line, start) GROUP BY unit"""
_FOLDS = """
wt AS (SELECT unit, count(*) AS spans FROM span GROUP BY unit),
ord AS (SELECT unit, spans, row_number() OVER (ORDER BY spans DESC, unit) AS k FROM wt),
go(k, loads, units, fold) AS (
    SELECT 0, [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[], -1
    UNION ALL
    SELECT o.k, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = b THEN o.spans ELSE 0 END), list_transform(range(1, 6), lambda j: units[j] + CASE WHEN j = b THEN 1 ELSE 0 END), b - 1
    FROM (SELECT k, loads, units, list_sort(list_transform(range(1, 6), lambda j: {'l': loads[j], 'u': units[j], 'j': j}))[1].j AS b FROM go) g JOIN ord o ON o.k = g.k + 1),
fold AS (SELECT unit, CAST(spans AS BIGINT) AS spans, CAST(fold AS INTEGER) AS fold FROM go JOIN ord USING (k))"""
_RANK = f"""WITH {_LINES}, {_sql_spans(2, 1)},
rk AS (SELECT v.*, s.gold, row_number() OVER (PARTITION BY doc_id, line, start ORDER BY support DESC, middle) AS rank FROM vote v JOIN span s USING (doc_id, line, start))"""
_DLOW, _DHIGH = _sql_wilson("included", "spans")


def _sql_horizon(mask: int) -> str:
    ctes, shown = "", []
    for a in (3, 2, 1):
        tag = f"_{mask}_{a}"
        ctes += f", {_sql_spans(a, mask, tag)}"
        shown.append(f"""SELECT doc_id, line, start, {a} AS a, count(*) AS size, max(CASE WHEN middle = gold THEN 1 ELSE 0 END) AS hit
            FROM (SELECT *, rank() OVER (PARTITION BY doc_id, line, start ORDER BY support DESC) AS k FROM vote{tag}) JOIN span{tag} USING (doc_id, line, start) WHERE k <= 5 GROUP BY doc_id, line, start""")
    return ctes + f""", best_{mask} AS (SELECT doc_id, line, start, max(a) AS a, arg_max(size, a) AS size, arg_max(hit, a) AS hit FROM ({' UNION ALL '.join(shown)}) GROUP BY ALL),
    hz_{mask} AS (SELECT {mask} AS mask, count(*) AS eligible, count(a) AS presented, count(*) FILTER (hit = 1) AS included, count(*) FILTER (size > 5) AS tie_expanded,
        count(*) FILTER (a = 3) AS anchor3, count(*) FILTER (a = 2) AS anchor2, count(*) FILTER (a = 1) AS anchor1 FROM span_{mask}_1 LEFT JOIN best_{mask} USING (doc_id, line, start))"""


def _sql_grid() -> str:
    ctes, parts = "", []
    for a in (1, 2, 3):
        for m in (1, 2, 3, 5):
            tag = f"_{a}_{m}"
            ctes += f", {_sql_spans(a, m, tag)}"
            sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("eligible", "supported", "exact", "variant_only", "ambiguous", "abstained"))
            parts.append(f"SELECT {a} AS anchors, {m} AS mask, {sums} FROM ({_CENSUS.format(tag=tag)})")
    return f"WITH {_LINES}{ctes} " + " UNION ALL ".join(parts)


QUERIES = {f.__name__: f for f in (
    witness_census_a2m1, witness_macro, witness_census_grid, family_vote_standings, rule_grid, rule_selection, folds_by_weight, cross_calibration,
    cross_calibration_strata, formulaicity, candidate_set_depths, rank_calibration, disagreement_taxonomy, anchor_repeats, adaptive_horizon)}

SQL = {
    "witness_census_a2m1": f"WITH {_LINES}, {_sql_spans(2, 1)} {_CENSUS.format(tag='')}",
    "witness_macro": f"WITH {_LINES}, {_sql_spans(2, 1)}, c AS ({_CENSUS.format(tag='')}), r AS (SELECT supported / CAST(eligible AS DOUBLE) AS rate FROM c WHERE eligible > 0) "
                     "SELECT count(*) AS units, round(avg(rate), 6) AS mean_rate, round(median(rate), 6) AS median_rate, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate FROM r",
    "witness_census_grid": _sql_grid(),
    "family_vote_standings": f"{_STAND} SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(start AS INTEGER) AS start, n_alt, CAST(total AS BIGINT) AS total, top, runner_up, margin, unique_top, top_exact, round(dominance, 6) AS dominance FROM st WHERE n_alt > 0",
    "rule_grid": f"{_STAND}, {_EVAL} SELECT rule_id, eligible, accepted, exact, coverage, lower, upper FROM evw",
    "rule_selection": f"{_STAND}, {_EVAL} SELECT target, rule_id, accepted, exact, coverage, lower FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY coverage DESC, lower DESC, rule_id) AS k "
                      "FROM evw JOIN (VALUES (0.7::DOUBLE), (0.8), (0.9), (0.95)) t(target) ON accepted >= 50 AND lower >= target) WHERE k = 1",
    "folds_by_weight": f"WITH RECURSIVE {_LINES}, {_sql_spans(2, 1)}, {_FOLDS} SELECT unit, spans, fold FROM fold",
    "cross_calibration": f"{_STAND.replace('WITH', 'WITH RECURSIVE', 1)}, {_FOLDS}, {_RULES}, "
        f"pf AS (SELECT fold, rule_id, CAST(sum(n) AS BIGINT) AS eligible, CAST(sum(CASE WHEN {_ACC} THEN n ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN {_ACC} AND top_exact THEN n ELSE 0 END) AS BIGINT) AS exact FROM prof JOIN fold USING (unit), rule GROUP BY ALL), "
        "oth AS (SELECT a.fold, a.rule_id, sum(b.eligible) AS eligible, sum(b.accepted) AS accepted, sum(b.exact) AS exact FROM pf a JOIN pf b ON a.rule_id = b.rule_id AND a.fold <> b.fold GROUP BY ALL), "
        f"ow AS (SELECT *, {_sql_pct('accepted', 'eligible')} AS coverage, {_LOW} AS lower FROM oth), "
        "tg AS (SELECT target FROM (VALUES (0.7::DOUBLE), (0.8), (0.9), (0.95)) t(target)), "
        "ch AS (SELECT fold, target, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY fold, target ORDER BY coverage DESC, lower DESC, rule_id) AS k FROM ow JOIN tg ON accepted >= 50 AND lower >= target) WHERE k = 1), "
        "fr AS (SELECT DISTINCT fold, eligible, target FROM pf, tg) "
        f"SELECT fr.fold, fr.target, ch.rule_id, fr.eligible, coalesce(pf.accepted, 0) AS accepted, coalesce(pf.exact, 0) AS exact, {_sql_pct('coalesce(pf.accepted, 0)', 'fr.eligible')} AS coverage, {_sql_pct('pf.exact', 'pf.accepted')} AS agreement, "
        "coalesce(pf.accepted > 0 AND pf.exact >= fr.target * pf.accepted, false) AS reached FROM fr LEFT JOIN ch ON fr.fold = ch.fold AND fr.target = ch.target LEFT JOIN pf ON pf.fold = ch.fold AND pf.rule_id = ch.rule_id",
    "cross_calibration_strata": f"{_STAND}, b AS (SELECT *, CASE WHEN total = 0 THEN 'none' WHEN total = 1 THEN 'one_family' WHEN total <= 3 THEN 'two_to_three_families' ELSE 'four_plus_families' END AS availability FROM st) "
        "SELECT availability, scope, unit, count(*) AS spans, count(*) FILTER (unique_top) AS unique_tops, count(*) FILTER (top_exact) AS exact FROM b GROUP BY GROUPING SETS ((availability), (scope), (unit))",
    "formulaicity": f"WITH {_LINES}, {_sql_spans(2, 1)}, wk AS (SELECT DISTINCT k.scope, k.unit, k.l, k.r FROM (SELECT scope, unit, l, array_to_string(t[i + 2 + m:i + 3 + m], chr(31)) AS r FROM (SELECT scope, unit, t, i, array_to_string(t[i:i + 1], chr(31)) AS l, unnest(range(0, least(13, len(t) - i - 2))) AS m FROM (SELECT *, unnest(range(1, len(t) - 2)) AS i FROM ln WHERE len(t) >= 4))) k SEMI JOIN span USING (scope, l, r)), "
        "u AS (SELECT scope, l, r, count(*) AS units FROM wk GROUP BY ALL) SELECT CASE WHEN units <= 1 THEN 'df_1' WHEN units <= 5 THEN 'df_2_5' ELSE 'df_6_plus' END AS band, count(*) AS anchors, CAST(sum(units) AS BIGINT) AS units FROM u GROUP BY 1",
    "candidate_set_depths": f"{_RANK}, per AS (SELECT doc_id, line, start, count(*) AS n, min(CASE WHEN middle = gold THEN rank END) AS g FROM rk GROUP BY ALL), "
        "d AS (SELECT depth, count(*) AS spans, count(*) FILTER (g <= depth) AS included, CAST(sum(least(depth, n)) AS BIGINT) AS shown FROM per, unnest([1, 2, 3, 5]) x(depth) GROUP BY depth) "
        f"SELECT depth, spans, included, shown, {_sql_pct('included', 'spans')} AS inclusion, {_DLOW} AS lower, {_DHIGH} AS upper FROM d",
    "rank_calibration": f"{_RANK} SELECT CAST(rank AS INTEGER) AS rank, count(*) AS available, count(*) FILTER (middle = gold) AS successes FROM rk WHERE rank <= 5 GROUP BY rank",
    "disagreement_taxonomy": f"{_RANK}, per AS (SELECT doc_id, line, start, min(CASE WHEN middle = gold THEN rank END) AS g, max(CASE WHEN rank = 1 THEN CASE WHEN middle = '' THEN 0 ELSE len(string_split(middle, chr(31))) END END) AS tl, "
        "max(CASE WHEN rank = 1 THEN support END) AS top, count(*) AS n FROM rk GROUP BY ALL) SELECT CASE WHEN g = 1 THEN 'TOP_EXACT_ATTESTED_AGREEMENT' WHEN g IS NOT NULL THEN 'ATTESTED_READING_LOWER_RANKED' WHEN tl = 0 THEN 'ATTESTED_READING_ABSENT_TOP_OMISSION' "
        "WHEN tl < 1 THEN 'ATTESTED_READING_ABSENT_TOP_SHORTER' WHEN tl = 1 THEN 'ATTESTED_READING_ABSENT_TOP_EQUAL_LENGTH_DIFFERENT' ELSE 'ATTESTED_READING_ABSENT_TOP_LONGER' END AS category, count(*) AS spans, "
        "count(*) FILTER (n > 1) AS several_middles, count(*) FILTER (top > 1) AS several_families, count(*) FILTER (g IS NULL) AS absent FROM per GROUP BY 1",
    "anchor_repeats": f"WITH {_LINES}, {_sql_spans(2, 1)}, per AS (SELECT doc_id, l, r, count(*) AS occurrences FROM span GROUP BY ALL) SELECT occurrences, count(*) AS anchors FROM per GROUP BY occurrences",
    "adaptive_horizon": f"WITH {_LINES}{''.join(map(_sql_horizon, HORIZON_MASKS))}, h AS ({' UNION ALL '.join(f'SELECT * FROM hz_{m}' for m in HORIZON_MASKS)}) SELECT *, {_sql_pct('presented', 'eligible')} AS coverage, {_sql_pct('included', 'eligible')} AS effective FROM h",
}
