"""Queries of splits, leakage, duplicates, versions, identifiers, coverage, contracts and dense search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, text
from ..operators.rejects import loaded
from ..operators.rendering import SPECIALS
from ..operators.rendering import vocabulary as vocabulary_of
from ..sources.tables import table
from .rejects import _JUDGED


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "splits", "doc_id", "cth", "site", "is_bin", "main_split").withColumn("label", audit.clean_label(F.col("main_split")))


def greedy_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf).where("cth is not null")
    open_cth = rows.groupBy("cth").agg(F.max(F.coalesce("is_bin", F.lit(False)).cast("int")).alias("bin"), F.countDistinct("doc_id").alias("docs")).where("bin = 0 and docs > 0")
    return audit.greedy_split(open_cth, "cth", "docs", {"train": 0.8, "dev": 0.1, "test": 0.1})


def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf).where("cth is not null and label is not null")
    return rows.groupBy("cth").agg(F.countDistinct("label").alias("labels"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("labels > 1")


def split_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf)
    return rows.groupBy("site").pivot("label", list(audit.LABELS)).agg(F.count(F.lit(1))).na.fill(0, list(audit.LABELS))


def sign_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of fragments in all and per label of their tablet."""
    frags = text.fragments(table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering"))
    one = _labels(spark, sf).where("label is not null").groupBy(F.col("doc_id").alias("parent")).agg(F.min("label").alias("label"), F.max("label").alias("hi")).where("label = hi").drop("hi")
    n = F.size("tokens")
    worn = F.size(F.filter("tokens", lambda t: t == "x"))
    return frags.join(one, "parent").rollup("label").agg(F.count(F.lit(1)).alias("fragments"), F.sum(n).alias("tokens"), F.sum(worn).alias("worn"))


def duplicate_topology(spark: SparkSession, sf: str) -> DataFrame:
    per = _labels(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cth").alias("c"), F.countDistinct("label").alias("l")).where("n > 1")
    kind = F.when(F.col("l") > 1, "cross_split").when(F.col("c") > 1, "cross_cth_same_split").otherwise("same_cth")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("rows"))


# The names of the gates, in the order they are met.
def access_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Every stem of the parse-error log by the gate it meets first."""
    stems = table(spark, sf, "parse_errors", "file").where("file is not null").select(F.regexp_extract("file", r"([^/]+)\.xml$", 1).alias("doc_id"))
    seen = stems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lab = _labels(spark, sf).groupBy("doc_id").agg(F.countDistinct("label").alias("k"), F.min("label").alias("label"))
    gate = (F.when(F.col("n") > 1, "QUARANTINE_DUPLICATE_STEM").when(F.col("k") > 1, "QUARANTINE_SPLIT_AMBIGUOUS").when(F.col("label").isNull(), "QUARANTINE_UNMATCHED")
            .when(F.col("label") == "test", "PROTECTED_TEST").when(~F.col("label").isin(*audit.LABELS), "QUARANTINE_UNKNOWN_SPLIT").otherwise(F.concat(F.lit("ALLOWED_"), F.upper("label"))))
    return seen.join(lab, "doc_id", "left").groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("stems"))


def error_log_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The loaded raw log against the table of errors, by file."""
    return audit.version_diff(table(spark, sf, "parse_errors", "file", "error"), loaded(table(spark, sf, "parse_errors_raw", "raw_id", "raw_record")), "file", "error")


def identifier_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "parse_errors", "file").where("file is not null").select(F.regexp_extract("file", r"([^/]+)\.xml$", 1).alias("l"))
    right = table(spark, sf, "splits", "doc_id").where("doc_id is not null").select(F.col("doc_id").alias("r"))
    passes = [
        ("exact", lambda c: c), ("plus_toggle", lambda c: F.regexp_replace(c, r"\+$", "")), ("format", lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))),
        ("one_edit", lambda c: F.concat_ws(" ", F.lower(F.substring(c, 1, 2)), F.regexp_extract(c, "([0-9]+)$", 1)), "near"),
        ("annotation", lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z]+ ?[0-9.]*[0-9])", 1)), "many")]
    return audit.reconcile(left, right, passes).groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.levenshtein("l", "r") == 0).alias("unchanged"))


def series_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf).withColumn("series", F.element_at(F.split("doc_id", " "), 1))
    g = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == s).alias(s) for s in audit.LABELS])
    return g.orderBy(F.desc("n"), "series").limit(10)


def pair_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs inside compositions, counted without listing one."""
    per = _labels(spark, sf).where("cth is not null").groupBy("cth").agg(F.countDistinct("doc_id").alias("n"), F.max(F.coalesce("is_bin", F.lit(False)).cast("int")).alias("bin"))
    pairs = F.expr("n * (n - 1) div 2")
    return per.groupBy("bin", audit.size_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("compositions"), F.sum("n").alias("documents"), F.sum(pairs).alias("pairs"))


def exact_text_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the class of its text: the least id, and how many documents share it."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    fam = text.families(docs)
    sizes = fam.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    return fam.join(sizes, "family").select("doc_id", "family", "members")


def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Price quantiles per priority: interpolated and nearest-rank."""
    o = table(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    return o.groupBy("o_orderpriority").agg(
        F.round(F.percentile("o_totalprice", 0.1), 4).alias("p10"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"),
        F.expr("percentile_disc(0.9) within group (order by o_totalprice)").alias("nearest_p90"))


def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "text", "lang", "source", "cth", "doc_kind")
    cols = ["text", "lang", "source", "cth", "doc_kind"]
    one = docs.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in cols])
    tall = one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in cols])).alias("x"))
    return tall.select("x.field", F.col("x.n").alias("present"), "total", F.round(100.0 * F.col("x.n") / F.col("total"), 2).alias("percent"))


def auc_by_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem", "l_linestatus", "l_discount", "l_returnflag").withColumn("hit", F.col("l_returnflag") == "R")
    return audit.auc(rows, "l_discount", "hit", "l_linestatus")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of at least two train fragments, numbered in order after the special tokens."""
    frags, train = _fragments_of(spark, sf, "train")
    return vocabulary_of(frags.join(train, "parent", "left_semi"), "fragment_id")


def _fragments_of(spark: SparkSession, sf: str, label: str) -> tuple[DataFrame, DataFrame]:
    frags = text.fragments(table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering"))
    return frags, _labels(spark, sf).where(F.col("label") == label).select(F.col("doc_id").alias("parent")).distinct()


def oov_rate(spark: SparkSession, sf: str) -> DataFrame:
    frags, train = _fragments_of(spark, sf, "train")
    known = frags.join(train, "parent", "left_semi").select(F.explode("tokens").alias("token")).distinct().withColumn("known", F.lit(1))
    dev = _labels(spark, sf).where("label = 'dev'").select(F.col("doc_id").alias("parent")).distinct()
    toks = frags.join(dev, "parent", "left_semi").select(F.explode("tokens").alias("token")).join(known, "token", "left")
    return toks.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("known").isNull()).alias("unknown"), F.round(F.avg(F.col("known").isNull().cast("double")), 6).alias("rate"))


def quality_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of each contract over the tables."""
    docs = table(spark, sf, "documents", "doc_id", "text", "n_chars")
    log = table(spark, sf, "failures", "failure_id", "doc_id", "query_rendering", "predicted_rendering", "kind")
    splits = _labels(spark, sf)
    n = F.count(F.lit(1)).alias("violations")
    lab = splits.groupBy("doc_id").agg(F.min("label").alias("label"))
    guarded = log.select("doc_id").distinct().join(lab, "doc_id", "left")
    verdict = F.when(F.col("label").isNull(), "guard_missing").when(~F.col("label").isin(*audit.LABELS), "guard_unknown").when(F.col("label") == "test", "guard_test")
    parts = [
        docs.where("text is not null and n_chars <> length(text)").agg(n).select(F.lit("equal_lengths").alias("contract"), "violations"),
        splits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(n).select(F.lit("unique_ids").alias("contract"), "violations"),
        log.where("kind = 'false_top1' and (coalesce(trim(query_rendering), '') = '' or coalesce(trim(predicted_rendering), '') = '')").agg(n).select(F.lit("both_sides_lexical").alias("contract"), "violations"),
        guarded.select(verdict.alias("contract")).where("contract is not null").groupBy("contract").agg(n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.dense_topk(table(spark, sf, "embeddings", "vec_id", "embedding"), 10)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def cosine_label_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best of the ten nearest vectors per query and label."""
    found = audit.dense_topk(table(spark, sf, "embeddings", "vec_id", "embedding"), 10).join(table(spark, sf, "embeddings", "vec_id", "label"), "vec_id")
    return found.groupBy("query_id", "label").agg(F.round(F.max("score"), 6).alias("score"), F.min("rank").alias("rank"))


def line_max_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten vectors in a row as the lines of a document."""
    found = audit.line_max(table(spark, sf, "embeddings", "vec_id", "embedding"), 10, 5)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_L = "lab AS (SELECT doc_id, cth, site, is_bin, nullif(lower(trim(main_split)), '') AS label FROM splits)"
_F = """rw AS (SELECT query_id AS id, query_rendering AS r FROM failures UNION ALL SELECT predicted, predicted_rendering FROM failures),
fr AS (SELECT id, max(array_to_string(list_filter(string_split_regex(r, '[ \t\r\n]+'), lambda z: z <> ''), ' ')) AS text FROM rw WHERE id IS NOT NULL AND r IS NOT NULL GROUP BY id),
fg AS (SELECT id, string_split(id, '::')[1] AS parent, string_split(text, ' ') AS t FROM fr WHERE text <> '')"""
_STEM = "regexp_extract(file, '([^/]+)\\.xml$', 1)"
_FORMS = {
    "exact": ("x", "one"), "plus_toggle": ("regexp_replace(x, '\\+$', '')", "one"), "format": ("lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))", "one"),
    "one_edit": ("lower(x[1:2]) || ' ' || regexp_extract(x, '([0-9]+)$', 1)", "near"), "annotation": ("lower(regexp_extract(x, '^([A-Za-z]+ ?[0-9.]*[0-9])', 1))", "many")}


def _sql_reconcile() -> str:
    ctes = [f"l0 AS (SELECT DISTINCT {_STEM} AS x FROM parse_errors WHERE file IS NOT NULL)", "r0 AS (SELECT DISTINCT doc_id AS x FROM splits WHERE doc_id IS NOT NULL)"]
    for i, (name, (form, mode)) in enumerate(_FORMS.items()):
        right = f"(SELECT {form} AS k, min(x) AS x FROM r{i} GROUP BY k HAVING count(*) = 1)"
        if mode == "near":
            ctes.append(f"c{i} AS (SELECT a.x AS l, b.x AS r FROM (SELECT x, {form} AS k FROM l{i}) a JOIN (SELECT x, {form} AS k FROM r{i}) b USING (k) WHERE levenshtein(a.x, b.x) <= 1)")
            ctes.append(f"m{i} AS (SELECT '{name}' AS name, l, r FROM c{i} WHERE l IN (SELECT l FROM c{i} GROUP BY l HAVING count(*) = 1) AND r IN (SELECT r FROM c{i} GROUP BY r HAVING count(*) = 1))")
        elif mode == "many":
            ctes.append(f"m{i} AS (SELECT '{name}' AS name, a.x AS l, b.x AS r FROM (SELECT {form} AS k, x FROM l{i}) a JOIN {right} b USING (k))")
        else:
            ctes.append(f"m{i} AS (SELECT '{name}' AS name, a.x AS l, b.x AS r FROM (SELECT {form} AS k, min(x) AS x FROM l{i} GROUP BY k HAVING count(*) = 1) a JOIN {right} b USING (k))")
        ctes += [f"l{i + 1} AS (SELECT x FROM l{i} WHERE x NOT IN (SELECT l FROM m{i}))", f"r{i + 1} AS (SELECT x FROM r{i}" + ("" if mode == "many" else f" WHERE x NOT IN (SELECT r FROM m{i})") + ")"]
    return "WITH " + ", ".join(ctes) + " SELECT name, count(*) AS matches, count(*) FILTER (l = r) AS unchanged FROM (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(_FORMS))) + ") GROUP BY name"


_BAND = "CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END"
_COS = """q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM c)"""

QUERIES = {f.__name__: f for f in (
    greedy_split, leakage_check, split_crosstab, sign_totals, duplicate_topology, access_gates, error_log_versions, identifier_reconciliation, series_counts, pair_budget,
    exact_text_classes, length_percentiles, field_coverage, auc_by_status, vocabulary, oov_rate, quality_contracts, cosine_topk, cosine_label_best, line_max_topk)}

SQL = {
    "greedy_split": f"""WITH RECURSIVE {_L}, w AS (SELECT cth, docs, row_number() OVER (ORDER BY docs DESC, md5(CAST(cth AS VARCHAR))) AS k FROM (SELECT cth, count(DISTINCT doc_id) AS docs FROM lab WHERE cth IS NOT NULL GROUP BY cth HAVING NOT bool_or(coalesce(is_bin, false)) AND count(DISTINCT doc_id) > 0)),
        go(k, t, pick) AS (SELECT 0, [0.0, 0.0, 0.0]::DOUBLE[], 0 UNION ALL SELECT w.k, list_transform([1, 2, 3], lambda i: t[i] + CASE WHEN i = b THEN w.docs ELSE 0 END), b
            FROM (SELECT k, t, list_position([t[1] / 0.8::DOUBLE, t[2] / 0.1::DOUBLE, t[3] / 0.1::DOUBLE], list_min([t[1] / 0.8::DOUBLE, t[2] / 0.1::DOUBLE, t[3] / 0.1::DOUBLE])) AS b FROM go) g JOIN w ON w.k = g.k + 1)
        SELECT cth, docs, ['train', 'dev', 'test'][pick] AS split FROM go JOIN w USING (k)""",
    "leakage_check": f"WITH {_L} SELECT cth, count(DISTINCT label) AS labels, min(label) AS lo, max(label) AS hi FROM lab WHERE cth IS NOT NULL AND label IS NOT NULL GROUP BY cth HAVING count(DISTINCT label) > 1",
    "split_crosstab": f"WITH {_L} SELECT site, " + ", ".join(f"count(*) FILTER (label = '{s}') AS {s}" for s in audit.LABELS) + " FROM lab GROUP BY site",
    "sign_totals": f"WITH {_L}, {_F}, o AS (SELECT doc_id, min(label) AS label FROM lab WHERE label IS NOT NULL GROUP BY doc_id HAVING min(label) = max(label)) SELECT label, count(*) AS fragments, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(t, lambda z: z = 'x'))) AS BIGINT) AS worn FROM fg JOIN o ON o.doc_id = fg.parent GROUP BY ROLLUP (label)",
    "duplicate_topology": f"WITH {_L}, p AS (SELECT doc_id, count(*) AS n, count(DISTINCT cth) AS c, count(DISTINCT label) AS l FROM lab GROUP BY doc_id HAVING count(*) > 1) SELECT CASE WHEN l > 1 THEN 'cross_split' WHEN c > 1 THEN 'cross_cth_same_split' ELSE 'same_cth' END AS kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY 1",
    "access_gates": f"WITH {_L}, s AS (SELECT {_STEM} AS doc_id, count(*) AS n FROM parse_errors WHERE file IS NOT NULL GROUP BY 1), b AS (SELECT doc_id, count(DISTINCT label) AS k, min(label) AS label FROM lab GROUP BY doc_id) "
                    "SELECT CASE WHEN n > 1 THEN 'QUARANTINE_DUPLICATE_STEM' WHEN k > 1 THEN 'QUARANTINE_SPLIT_AMBIGUOUS' WHEN label IS NULL THEN 'QUARANTINE_UNMATCHED' WHEN label = 'test' THEN 'PROTECTED_TEST' WHEN label NOT IN ('train', 'dev', 'test', 'discovery') THEN 'QUARANTINE_UNKNOWN_SPLIT' ELSE 'ALLOWED_' || upper(label) END AS gate, count(*) AS stems FROM s LEFT JOIN b USING (doc_id) GROUP BY 1",
    "error_log_versions": _JUDGED + ", a AS (SELECT file, min(error) AS x FROM parse_errors WHERE file IS NOT NULL GROUP BY file), b AS (SELECT file, min(error) AS y FROM judged WHERE reason IS NULL GROUP BY file) "
                          "SELECT CASE WHEN b.file IS NULL THEN 'only_left' WHEN a.file IS NULL THEN 'only_right' WHEN x IS NOT DISTINCT FROM y THEN 'equal' ELSE 'changed' END AS status, count(*) AS keys FROM a FULL JOIN b ON a.file = b.file GROUP BY 1",
    "identifier_reconciliation": _sql_reconcile(),
    "series_counts": f"WITH {_L} SELECT string_split(doc_id, ' ')[1] AS series, count(*) AS n, " + ", ".join(f"count(*) FILTER (label = '{s}') AS {s}" for s in audit.LABELS) + " FROM lab GROUP BY 1 ORDER BY n DESC, series LIMIT 10",
    "pair_budget": f"WITH {_L}, p AS (SELECT cth, count(DISTINCT doc_id) AS n, CAST(bool_or(coalesce(is_bin, false)) AS INTEGER) AS bin FROM lab WHERE cth IS NOT NULL GROUP BY cth) SELECT bin, {_BAND} AS band, count(*) AS compositions, CAST(sum(n) AS BIGINT) AS documents, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM p GROUP BY ALL",
    "exact_text_classes": "WITH f AS (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS family FROM documents) SELECT doc_id, family, count(*) OVER (PARTITION BY family) AS members FROM f",
    "length_percentiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, quantile_disc(o_totalprice, 0.9) AS nearest_p90 FROM orders GROUP BY 1",
    "field_coverage": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) AS total FROM documents" for c in ("text", "lang", "source", "cth", "doc_kind")) + ") SELECT *, round(100.0 * present / CAST(total AS DOUBLE), 2) AS percent FROM c",
    "auc_by_status": "WITH p AS (SELECT l_linestatus, l_discount, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_linestatus ORDER BY l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) "
                     "SELECT l_linestatus, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * (below + n / 2.0::DOUBLE)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) END AS auc FROM b GROUP BY 1",
    "vocabulary": f"WITH {_L}, {_F}, v AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM fg WHERE parent IN (SELECT doc_id FROM lab WHERE label = 'train')) GROUP BY token HAVING count(*) >= 2) SELECT token, df, row_number() OVER (ORDER BY token) + {len(SPECIALS) - 1} AS id FROM v",
    "oov_rate": f"WITH {_L}, {_F}, v AS (SELECT DISTINCT unnest(t) AS token FROM fg WHERE parent IN (SELECT doc_id FROM lab WHERE label = 'train')), d AS (SELECT unnest(t) AS token FROM fg WHERE parent IN (SELECT doc_id FROM lab WHERE label = 'dev')) "
                "SELECT count(*) AS tokens, count(*) FILTER (v.token IS NULL) AS unknown, round(avg(CASE WHEN v.token IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate FROM d LEFT JOIN v USING (token)",
    "quality_contracts": f"""WITH {_L}, g AS (SELECT CASE WHEN label IS NULL THEN 'guard_missing' WHEN label NOT IN ('train', 'dev', 'test', 'discovery') THEN 'guard_unknown' WHEN label = 'test' THEN 'guard_test' END AS contract
            FROM (SELECT DISTINCT doc_id FROM failures) f LEFT JOIN (SELECT doc_id, min(label) AS label FROM lab GROUP BY doc_id) b USING (doc_id))
        SELECT 'equal_lengths' AS contract, count(*) AS violations FROM documents WHERE text IS NOT NULL AND n_chars <> length(text)
        UNION ALL SELECT 'unique_ids', count(*) FROM (SELECT doc_id FROM splits GROUP BY doc_id HAVING count(*) > 1)
        UNION ALL SELECT 'both_sides_lexical', count(*) FROM failures WHERE kind = 'false_top1' AND (coalesce(trim(query_rendering), '') = '' OR coalesce(trim(predicted_rendering), '') = '')
        UNION ALL SELECT contract, count(*) FROM g WHERE contract IS NOT NULL GROUP BY contract""",
    "cosine_topk": f"WITH {_COS} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM k WHERE rank <= 10",
    "line_max_topk": """WITH q AS (SELECT vec_id // 10 AS d, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT a.d AS query_id, b.d AS doc_id, max(list_cosine_similarity(a.e, b.e)) AS s FROM q a JOIN q b ON a.d <> b.d WHERE a.d % 100 = 0 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM k WHERE rank <= 5""",
    "cosine_label_best": f"WITH {_COS} SELECT query_id, label, round(max(s), 6) AS score, CAST(min(rank) AS INTEGER) AS rank FROM k JOIN embeddings USING (vec_id) WHERE rank <= 10 GROUP BY ALL",
}
