"""Queries of inventories, counters, chains, seams, packets and classification by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import jaccard
from ..operators import audit, bayes, packets, passages, text, witness
from ..operators import rendering as rn
from ..operators import sampling as sm
from ..operators import structure as st
from ..sources.tables import spread, table
from ..storage import Scratch
from . import witness as pw
from .audit import _L as _LABELS

_TAGS = r"(\{\p{L}+\}|<[A-Za-z]+>)"


def tag_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Which tag follows which in a text: the twenty commonest edges, with the first three documents that show them."""
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    tags = docs.select("doc_id", F.regexp_extract_all("text", F.lit(_TAGS), 1).alias("ts")).where("size(ts) > 1")
    edges = tags.select("doc_id", F.explode(F.transform(F.slice("ts", F.lit(2), F.size("ts")), lambda t, i: F.struct(F.get("ts", i).alias("tag"), t.alias("then")))).alias("e")).select("doc_id", "e.*")
    per = edges.groupBy("tag", "then", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("tag", "then").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("documents")).orderBy(F.desc("instances"), "tag", "then").limit(20)
    w = Window.partitionBy("tag", "then").orderBy("doc_id")
    shown = per.join(F.broadcast(top), ["tag", "then"]).withColumn("k", F.row_number().over(w)).where("k <= 3")  # twenty rows
    return shown.groupBy("tag", "then", "instances", "documents").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")), ",").alias("examples"))


def attribute_census(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of events by the type that carries them: instances, and users that have them."""
    rows = table(spark, sf, "events", "user_id", "event_type", "props").select("user_id", "event_type", F.explode(F.regexp_extract_all("props", F.lit('"([A-Za-z_]+)":'), 1)).alias("a"))
    return rows.groupBy(F.concat_ws("@", "event_type", "a").alias("attribute")).agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("user_id").alias("users"))


def extension_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the error log by extension, and their composition folders."""
    files = table(spark, sf, "parse_errors", "file").where("file is not null")
    return files.groupBy(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.regexp_extract("file", r"CTH (\d+)_XML/", 1)).alias("compositions"))


def line_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty lines to look at, drawn by a hash of document and line."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text").where("text is not null"))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where("trim(s) <> ''")
    drawn = rows.select("doc_id", "line", F.length("s").alias("characters"), F.md5(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string"), F.col("line").cast("string"))).alias("h"))
    return drawn.orderBy("h").limit(40).select("doc_id", "line", "characters")


def pair_combiner(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic combiner of three scores of logged pairs, fitted to tell true positives from false first places: its weights (no SQL states it)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    log = table(spark, sf, "failures", "failure_id", "kind", "rank", "query_rendering", "predicted_rendering").where("query_rendering is not null").dropDuplicates(["failure_id"])

    def toks(c):
        return F.coalesce(F.filter(F.split(c, "[ \t\r\n]+"), lambda t: t != ""), F.array().cast("array<string>"))

    rows = log.select((F.col("kind") == "worst_true_positive").cast("double").alias("label"), toks("query_rendering").alias("a"), toks("predicted_rendering").alias("b"))
    known = rows.select(
        "label", F.size("a").cast("double").alias("length"), F.size(F.array_distinct("a")).cast("double").alias("distinct"), (F.size(F.filter("a", lambda t: t == "x")) / F.greatest(F.size("a"), F.lit(1))).alias("worn"))
    names = ["length", "distinct", "worn"]
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(VectorAssembler(inputCols=names, outputCol="features").transform(known).select("label", "features"))
    return spark.createDataFrame([(n, round(float(c), 4)) for n, c in zip([*names, "intercept"], [*model.coefficients, model.intercept])], "feature string, weight double")


def running_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Line, word and paragraph counters of every word, begun at -1, -1 and 0, summed per document; a line without words ends a paragraph."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text").where("text is not null"))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).select("doc_id", "line", text.tokens(F.col("s")).alias("t"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("t")
    counted = rows.select(
        "doc_id", n.alias("n"), "line", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum((n == 0).cast("int")).over(before), F.lit(0)).alias("par")).where("n > 0")
    last = F.col("words_before") + F.col("n") - 1
    return counted.groupBy("doc_id").agg(
        F.sum(F.col("line") * F.col("n")).alias("line_sum"), F.sum((F.col("words_before") + last) * F.col("n") / 2).cast("long").alias("word_sum"), F.sum(F.col("par") * F.col("n")).alias("paragraph_sum"), F.max(last).alias("last_word"))


#: Prefixes of tablet names in the order they are tried: the first that fits counts, so a longer one behind a shorter is never met.
PREFIXES = (("TbA ", "Tabal"), ("T", "T-series"), ("Tb", "never"), ("HoS", "Hos"), ("KTZ", "Katz"), ("K", "K-series"), ("NUT", "Nut"), ("MrB", "Mara"))


def site_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    site = None
    for p, name in PREFIXES:
        hit = F.col("doc_id").startswith(p)
        site = F.when(hit, name) if site is None else site.when(hit, name)
    return table(spark, sf, "splits", "doc_id").where("doc_id is not null").groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("rows"))


def member_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs written as chains and read back: how the second member joins the first."""
    pairs = table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b", "join_type").where("join_type in ('+', '(+)')")
    clean = [F.regexp_replace(c, r"[+(){}\s]", "") for c in ("fragment_id_a", "fragment_id_b")]
    chain = F.concat(F.lit("{"), clean[0], F.col("join_type"), clean[1], F.lit("}"))
    read = pairs.select("join_type", st.member_chain(chain).alias("m")).where("m is not null")
    return read.groupBy("join_type", F.element_at("m", -1)["join"].alias("join"), F.size("m").alias("members")).agg(F.count(F.lit(1)).alias("pairs"))


def duplicate_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Tablets that stand several times, by the compositions and labels they stand under, written as one signature."""
    rows = table(spark, sf, "splits", "doc_id", "cth", "main_split").withColumn("label", audit.clean_label(F.col("main_split"))).where("doc_id is not null")
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("cth")).alias("k"), F.array_join(F.array_sort(F.collect_set("label")), "+").alias("labels")).where("n > 1")
    return per.groupBy(F.concat_ws("|", F.least("k", F.lit(3)).cast("string"), "labels").alias("signature")).agg(F.count(F.lit(1)).alias("tablets"), F.sum("n").alias("rows"))


def task_a_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by whether their composition has a witness of another family: others are counted and left out of the measure."""
    docs = table(spark, sf, "documents", "doc_id", "text", "cth")
    fam = docs.select("doc_id", "cth").join(text.families(docs), "doc_id")
    sizes = fam.where("cth is not null").groupBy("cth").agg((F.min("family") != F.max("family")).alias("several"))
    q = fam.where("doc_id % 100 = 0").join(sizes, "cth", "left")
    return q.groupBy(F.when(F.col("cth").isNull(), "no_composition").when(F.col("several"), "answerable").otherwise("single_witness").alias("status")).agg(F.count(F.lit(1)).alias("queries"))


def seam_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every logged pair joined at four offsets in two directions; the best seam with its place, and how many are above a tenth.

    The score of a seam is the Jaccard measure of the eight tokens on either side of it.
    """
    log = spread(table(spark, sf, "failures", "failure_id", "query_rendering", "predicted_rendering").where("query_rendering is not null and predicted_rendering is not null")).groupBy("failure_id").agg(
        F.max("query_rendering").alias("q"), F.max("predicted_rendering").alias("p"))

    def toks(c):
        return F.filter(F.split(c, "[ \t\r\n]+"), lambda t: t != "")

    two = log.select("failure_id", toks("q").alias("q"), toks("p").alias("p"))
    each = two.select("failure_id", F.explode(F.array(F.struct(F.lit("forward").alias("direction"), F.col("q").alias("a"), F.col("p").alias("b")), F.struct(F.lit("reverse").alias("direction"), F.col("p").alias("a"), F.col("q").alias("b")))).alias("d"))
    seams = each.select("failure_id", "d.*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("offset"))
    end = F.size("a") - F.col("offset")
    left = F.when(end > 0, F.slice("a", F.greatest(F.lit(1), end - 7), F.least(F.lit(8), end))).otherwise(F.array().cast("array<string>"))
    scored = seams.select("failure_id", "direction", "offset", F.round(jaccard(F.array_distinct(left), F.array_distinct(F.slice("b", F.lit(1), F.lit(8)))), 6).alias("score"))
    return sm.best_with_place(scored, ["failure_id"], "score", ["direction", "offset"], 0.1)


_RULE = (1, 2, 0.0, 2)


def _outcomes(spark: SparkSession, lines: DataFrame, w: DataFrame) -> DataFrame:
    told = witness.standings(w, [1])
    s, m, d, a = _RULE
    ok = F.col("unique_top") & (F.col("top") >= s) & (F.col("margin") >= m) & (F.col("dominance") >= d) & (F.col("n_alt") <= a)
    return told.select(*pw.SPAN, "n_alt", "total", rn.outcome(F.col("n_alt"), F.col("unique_top"), ok, F.col("top_exact")).alias("outcome"))


def packet_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What would be presented of all spans under the rule s1_m2_d0p0_a2."""
    lines = Scratch(spark, "outcomes").cut(pw._lines(spark, sf), "lines")
    w = pw._counted(spark, lines)
    spans = w.where("len = 1").groupBy(*pw.SPAN).agg(F.sum("c").alias("c"))
    told = spans.join(_outcomes(spark, lines, w), pw.SPAN).groupBy("outcome").agg(F.sum("c").alias("spans"))
    asked = witness.eligible(lines, 2, [1], "scope", "unit").agg(F.coalesce(F.sum("eligible"), F.lit(0)).alias("n"))
    given = told.agg(F.coalesce(F.sum("spans"), F.lit(0)).alias("given"))
    silent = asked.join(given).select(F.lit(packets.OUTCOMES[0]).alias("outcome"), (F.col("n") - F.col("given")).alias("spans")).where("spans > 0")
    return told.unionByName(silent)


def evidence_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Five packets of each outcome, of one source each first: what a reader is shown."""
    known = passages.Passages(pw._lines(spark, sf), "scope", "unit", ordered=True)
    spans = passages.firsts_of_units(known, 2, 1, _RULE, 5, 5)  # a bucket's first five of a unit are all that a quota of five can take
    told = spans.withColumn("outcome", rn.outcome(F.col("n_alt"), F.col("unique_top"), F.col("accepted"), F.col("top_exact")))
    picked = Scratch(spark, "packets").cut(sm.quota(told, "outcome", "unit", ["doc_id", "line", "start"], 5), "picked")
    made = packets.body(picked, ["doc_id", "line", "start"])
    return picked.select("doc_id", "line", "start", "outcome", "n_alt", "total", "place").join(made, ["doc_id", "line", "start"]).select("outcome", "place", "doc_id", "line", "start", "n_alt", "total", "action")


def disagreement_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Spans whose first proposal is not the attested reading, with the flags that may explain it."""
    r = passages.disagreements(passages.Passages(pw._lines(spark, sf), "scope", "unit", ordered=True), 2, 1)
    flags = {"several_middles": "middles", "top_of_several_families": "families", "anchor_in_several_units": "units", "anchor_repeats_in_document": "again", "attested_absent": "absent"}
    return r.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("disagreements"), *[F.coalesce(F.sum(F.col("c") * F.col(x)), F.lit(0)).alias(name) for name, x in flags.items()])


def nb_language(spark: SparkSession, sf: str) -> DataFrame:
    """Naive Bayes on the words of documents, ten folds within each language: accuracy per language."""
    docs = table(spark, sf, "documents", "doc_id", "lang", "text").where("lang is not null and text is not null")
    toks = spread(docs).select("doc_id", "lang", text.tokens(F.regexp_replace("text", "\n", " ")).alias("tokens"))
    data = Scratch(spark, "bayes").cut(bayes.folded(toks, "doc_id", "lang", 10), "docs")
    out = bayes.predicted(data, "doc_id", "lang")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("guess") == F.col("lang")).alias("right"))


_Q = "list_filter(string_split_regex({c}, '[ \t\r\n]+'), lambda z: z <> '')"
QUERIES = {f.__name__: f for f in (
    tag_inventory, attribute_census, extension_counts, line_sample, pair_combiner, running_counters, site_by_prefix, member_chains, duplicate_signatures, task_a_coverage, seam_scores, packet_outcomes, evidence_packets, disagreement_flags, nb_language)}

_OUT = "CASE WHEN n_alt = 0 THEN 'abstain_no_anchor_evidence' WHEN NOT unique_top THEN 'abstain_evidence_tie' WHEN NOT (top >= 1 AND margin >= 2 AND n_alt <= 2) THEN 'abstain_calibrated_threshold' WHEN top_exact THEN 'accepted_exact_agreement' ELSE 'accepted_variant' END"
_JAC = "CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0.0 ELSE len(list_intersect(l, r)) / CAST(len(list_distinct(list_concat(l, r))) AS DOUBLE) END"
SQL = {
    "tag_inventory": r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(\{\p{L}+\}|<[A-Za-z]+>)', 1) AS ts FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, ts[i] AS tag, ts[i + 1] AS nx FROM (SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM t WHERE len(ts) > 1)),
        g AS (SELECT tag, nx, count(*) AS n, count(DISTINCT doc_id) AS d, list_sort(list(DISTINCT doc_id))[1:3] AS x FROM e GROUP BY ALL)
        SELECT tag, nx AS "then", n AS instances, d AS documents, array_to_string(x, ',') AS examples FROM g ORDER BY n DESC, tag, nx LIMIT 20""",
    "attribute_census": "WITH a AS (SELECT user_id, event_type || '@' || unnest(regexp_extract_all(props, '\"([A-Za-z_]+)\":', 1)) AS attribute FROM events) SELECT attribute, count(*) AS instances, count(DISTINCT user_id) AS users FROM a GROUP BY attribute",
    "extension_counts": "SELECT lower(regexp_extract(file, '\\.([^./]+)$', 1)) AS extension, count(*) AS files, count(DISTINCT regexp_extract(file, 'CTH (\\d+)_XML/', 1)) AS compositions FROM parse_errors WHERE file IS NOT NULL GROUP BY 1",
    "line_sample": "WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(length(s) AS INTEGER) AS characters FROM l WHERE trim(s) <> '' ORDER BY md5('42:' || doc_id || ':' || line) LIMIT 40",
    "running_counters": """WITH l AS (SELECT doc_id, line, len(list_filter(string_split_regex(s, '[ \t\r]+'), lambda z: z <> '')) AS n FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL)),
        c AS (SELECT *, coalesce(sum(n) OVER w, 0) AS b, coalesce(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER w, 0) AS p FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id, CAST(sum(line * n) AS BIGINT) AS line_sum, CAST(sum((2 * b + n - 1) * n // 2) AS BIGINT) AS word_sum, CAST(sum(p * n) AS BIGINT) AS paragraph_sum, CAST(max(b + n - 1) AS BIGINT) AS last_word FROM c WHERE n > 0 GROUP BY doc_id""",
    "site_by_prefix": "SELECT CASE " + " ".join(f"WHEN starts_with(doc_id, '{p}') THEN '{n}'" for p, n in PREFIXES) + " END AS site, count(*) AS rows FROM splits WHERE doc_id IS NOT NULL GROUP BY 1",
    "member_chains": "SELECT join_type, CASE WHEN join_type = '+' THEN 'direct' ELSE 'indirect' END AS \"join\", 2 AS members, count(*) AS pairs FROM join_pairs WHERE join_type IN ('+', '(+)') AND fragment_id_a IS NOT NULL AND fragment_id_b IS NOT NULL GROUP BY join_type",
    "duplicate_signatures": f"WITH {_LABELS}, p AS (SELECT doc_id, count(*) AS n, count(DISTINCT cth) AS k, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), '+'), '') AS l FROM lab WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1) "
                            "SELECT least(k, 3) || '|' || l AS signature, count(*) AS tablets, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY 1",
    "task_a_coverage": "WITH f AS (SELECT doc_id, cth, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS family FROM documents), s AS (SELECT cth, min(family) <> max(family) AS v FROM f WHERE cth IS NOT NULL GROUP BY cth) "
                       "SELECT CASE WHEN f.cth IS NULL THEN 'no_composition' WHEN v THEN 'answerable' ELSE 'single_witness' END AS status, count(*) AS queries FROM f LEFT JOIN s ON s.cth = f.cth WHERE doc_id % 100 = 0 GROUP BY 1",
    "seam_scores": f"""WITH g AS (SELECT failure_id, max(query_rendering) AS q, max(predicted_rendering) AS p FROM failures WHERE query_rendering IS NOT NULL AND predicted_rendering IS NOT NULL GROUP BY failure_id),
        t AS (SELECT failure_id, {_Q.format(c='q')} AS q, {_Q.format(c='p')} AS p FROM g), d AS (SELECT failure_id, 'forward' AS direction, q AS a, p AS b FROM t UNION ALL SELECT failure_id, 'reverse', p, q FROM t),
        s AS (SELECT failure_id, direction, o, list_distinct(CASE WHEN len(a) - o > 0 THEN a[greatest(1, len(a) - o - 7):len(a) - o] ELSE []::VARCHAR[] END) AS l, list_distinct(b[1:8]) AS r FROM d, unnest([0, 1, 2, 3]) u(o)),
        j AS (SELECT failure_id, direction, o, round({_JAC}, 6) AS v FROM s)
        SELECT failure_id, -b.s AS best, b.d AS direction, CAST(b.o AS INTEGER) AS "offset", n_above FROM (SELECT failure_id, min({{'s': -v, 'd': direction, 'o': o}}) AS b, count(*) FILTER (v > 0.1::DOUBLE) AS n_above FROM j GROUP BY failure_id)""",
    "packet_outcomes": f"{pw._STAND} SELECT {_OUT} AS outcome, count(*) AS spans FROM st GROUP BY 1",
    "evidence_packets": f"""{pw._STAND}, o AS (SELECT *, {_OUT} AS outcome FROM st WHERE n_alt > 0), n AS (SELECT *, row_number() OVER (PARTITION BY outcome, unit ORDER BY doc_id, line, start) AS nth FROM o),
        k AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, doc_id, line, start) AS place FROM n)
        SELECT outcome, CAST(place AS INTEGER) AS place, doc_id, CAST(line AS INTEGER) AS line, CAST(start AS INTEGER) AS start, n_alt, CAST(total AS BIGINT) AS total, CASE WHEN starts_with(outcome, 'accepted') THEN 'present_one' ELSE 'abstain' END AS action FROM k WHERE place <= 5""",
    "disagreement_flags": f"""{pw._RANK}, u AS (SELECT scope, l, r, count(DISTINCT unit) AS units FROM (SELECT DISTINCT scope, unit, l, array_to_string(t[i + 2 + m:i + 3 + m], chr(31)) AS r FROM (SELECT scope, unit, t, i, array_to_string(t[i:i + 1], chr(31)) AS l, unnest(range(0, least(13, len(t) - i - 2))) AS m FROM (SELECT *, unnest(range(1, len(t) - 2)) AS i FROM ln WHERE len(t) >= 4))) GROUP BY ALL),
        ag AS (SELECT doc_id, l, r, count(*) AS again FROM span GROUP BY ALL),
        p AS (SELECT doc_id, line, start, count(*) AS n, max(support) AS top, bool_or(rank = 1 AND middle = gold) AS okay, bool_or(middle = gold) AS here FROM rk GROUP BY ALL)
        SELECT count(*) AS disagreements, count(*) FILTER (n > 1) AS several_middles, count(*) FILTER (top > 1) AS top_of_several_families, count(*) FILTER (units > 1) AS anchor_in_several_units, count(*) FILTER (again > 1) AS anchor_repeats_in_document, count(*) FILTER (NOT here) AS attested_absent
        FROM p JOIN span USING (doc_id, line, start) JOIN u USING (scope, l, r) JOIN ag USING (doc_id, l, r) WHERE NOT okay""",
    "nb_language": """WITH d AS (SELECT doc_id, lang, list_filter(string_split_regex(replace(text, chr(10), ' '), '[ \t\r]+'), lambda z: z <> '') AS t, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 10 AS fold FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
        tf AS (SELECT doc_id, lang, fold, token, count(*) AS tf FROM (SELECT doc_id, lang, fold, unnest(t) AS token FROM d) GROUP BY ALL),
        fo AS (SELECT DISTINCT fold FROM d), tr AS (SELECT fo.fold, lang AS guess, token, sum(tf) AS k FROM fo JOIN tf ON tf.fold <> fo.fold GROUP BY ALL),
        vo AS (SELECT fold, count(DISTINCT token) AS v FROM tr GROUP BY fold), nn AS (SELECT fold, guess, sum(k) AS n FROM tr GROUP BY ALL),
        pr AS (SELECT fo.fold, lang AS guess, count(*) AS docs FROM fo JOIN d ON d.fold <> fo.fold GROUP BY ALL),
        fr AS (SELECT pr.fold, pr.guess, ln(docs / CAST(sum(docs) OVER (PARTITION BY pr.fold) AS DOUBLE)) AS prior, ln(coalesce(n, 0) + v) AS norm FROM pr JOIN vo USING (fold) LEFT JOIN nn ON nn.fold = pr.fold AND nn.guess = pr.guess),
        kn AS (SELECT tf.* FROM tf SEMI JOIN tr ON tr.fold = tf.fold AND tr.token = tf.token),
        le AS (SELECT doc_id, sum(tf) AS len FROM kn GROUP BY doc_id), ga AS (SELECT doc_id, guess, sum(tf * ln(k + 1.0::DOUBLE)) AS gain FROM kn JOIN tr ON tr.fold = kn.fold AND tr.token = kn.token GROUP BY ALL),
        sc AS (SELECT d.doc_id, d.lang, fr.guess, round(prior + coalesce(gain, 0) - coalesce(len, 0) * norm, 6) AS s FROM d JOIN fr USING (fold) LEFT JOIN le ON le.doc_id = d.doc_id LEFT JOIN ga ON ga.doc_id = d.doc_id AND ga.guess = fr.guess),
        be AS (SELECT doc_id, lang, min({'s': -s, 'g': guess}).g AS guess FROM sc GROUP BY ALL) SELECT lang, count(*) AS documents, count(*) FILTER (guess = lang) AS "right" FROM be GROUP BY lang""",
}
