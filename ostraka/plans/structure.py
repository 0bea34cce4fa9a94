"""Queries of marked-up texts, runs, line structure and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure as st
from ..sources.tables import spread, table


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return st.words(spread(table(spark, sf, "documents", "doc_id", "text")))


def milestone_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = st.milestone_states(_words(spark, sf))
    return s.groupBy("doc_id").agg(*[F.count_if(F.col("state") == x).alias(x) for x in st.STATES])


def restored_run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of restored runs, capped at 20."""
    runs = st.islands(st.milestone_states(_words(spark, sf)), "doc_id", ["pos"], "state").where("state = 'restored'")
    return runs.groupBy(F.least("length", F.lit(20)).alias("length")).agg(F.count(F.lit(1)).alias("runs"))


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = st.islands(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("event_type", F.least("length", F.lit(20)).alias("length")).agg(F.count(F.lit(1)).alias("runs"))


def line_word_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, words and paragraphs of each document; a paragraph ends at a blank line."""
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    n = F.size(F.filter(F.split("s", "[ \t\r]+"), lambda t: t != ""))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(n).alias("words"), F.count_if(n == 0).alias("blank_lines"), F.max(n).alias("longest_line"))


def word_classes(spark: SparkSession, sf: str) -> DataFrame:
    langs = table(spark, sf, "documents", "doc_id", "lang")
    return _words(spark, sf).join(langs, "doc_id").groupBy("lang", st.word_class(F.col("word")).alias("class")).agg(F.count(F.lit(1)).alias("words"))


def sign_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.signs(st.milestone_states(_words(spark, sf)), "doc_id")
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("signs"), F.sum("offset").cast("long").alias("offsets"), F.countDistinct("sign").alias("kinds"))


def line_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    lab = st.line_label(F.col("s"))
    rows = docs.select(F.explode(F.split("text", "\n")).alias("s")).select(*[c.alias(n) for n, c in lab.items()])
    return rows.groupBy("side", "prime").agg(F.count(F.lit(1)).alias("lines"), F.max("number").alias("highest"))


def parser_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """Bracket marks counted in the raw text against words parsed as restored, per document."""
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    raw = docs.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("["), F.lit("")))).alias("opens"))
    parsed = st.milestone_states(_words(spark, sf)).groupBy("doc_id").agg(F.count_if(F.col("state") == "restored").alias("restored"))
    both = raw.join(parsed, "doc_id", "left").select("opens", F.coalesce("restored", F.lit(0)).alias("restored"))
    return both.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("opens") == F.col("restored")).alias("equal"),
                    F.round(F.avg(F.abs(F.col("opens") - F.col("restored"))), 6).alias("mean_difference"), F.round(F.corr("opens", "restored"), 6).alias("correlation"))


def codepoint_classes(spark: SparkSession, sf: str) -> DataFrame:
    chars = table(spark, sf, "documents", "text").where("text is not null").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return chars.groupBy(st.codepoint_class(F.col("c")).alias("class")).agg(F.count(F.lit(1)).alias("characters"))


def schema_census(spark: SparkSession, sf: str) -> DataFrame:
    """Braced and angled tags of texts: instances, and documents that have them."""
    docs = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    tags = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\{\p{L}+\}|<[A-Za-z]+>)"), 1)).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("doc_id").alias("documents"))


def site_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest site of each siglum prefix; ties go to the first name."""
    rows = table(spark, sf, "splits", "doc_id", "site").where("site is not null")
    counts = rows.groupBy(F.element_at(F.split("doc_id", " "), 1).alias("prefix"), "site").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("prefix").agg(F.min(F.struct((-F.col("n")).alias("m"), "site")).alias("b"), F.sum("n").alias("rows")).select("prefix", F.col("b.site").alias("site"), (-F.col("b.m")).alias("n"), "rows")


def relation_bases(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "join_pairs", "pair_id", "join_type", "tier", "fragment_id_a", "fragment_id_b").distinct()
    same = F.element_at(F.split("fragment_id_a", "::"), 1) == F.element_at(F.split("fragment_id_b", "::"), 1)
    return pairs.groupBy(st.relation_basis(F.col("join_type"), F.coalesce(same, F.lit(False))).alias("basis"), "tier").agg(F.count(F.lit(1)).alias("pairs"))


def structural_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of an order set against those of the next."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("ps"))
    nxt = lines.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("ps").alias("qs"))
    return st.structural_relation(lines.join(nxt, "l_orderkey"), "ps", "qs").groupBy("ordering", "identifiable", "consistent").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"))


_W = """
wd AS (SELECT doc_id, line, w, word, row_number() OVER (PARTITION BY doc_id ORDER BY line, w) - 1 AS pos FROM (
    SELECT doc_id, line, unnest(range(len(t))) AS w, unnest(t) AS word FROM (
        SELECT doc_id, line, list_filter(string_split_regex(s, '[ \t\r]+'), lambda z: z <> '') AS t FROM (
            SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL))))"""


def _mark(o: str, c: str, word: str = "word") -> str:
    a, b = f"strpos(reverse({word}), '{o}')", f"strpos(reverse({word}), '{c}')"
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN NULL WHEN {b} = 0 THEN 1 WHEN {a} = 0 THEN 0 WHEN {a} < {b} THEN 1 ELSE 0 END"


_ST = f"""{_W},
mk AS (SELECT *, {_mark('[', ']')} AS dm, {_mark('⸢', '⸣')} AS lm FROM wd),
sr AS (SELECT *, coalesce(last_value(dm IGNORE NULLS) OVER b, 0) = 1 AS ro, coalesce(last_value(lm IGNORE NULLS) OVER b, 0) = 1 AS dd,
    coalesce(last_value(dm IGNORE NULLS) OVER b, 0) = 1 OR contains(word, '[') AS r, coalesce(last_value(lm IGNORE NULLS) OVER b, 0) = 1 OR contains(word, '⸢') AS d FROM mk WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ws AS (SELECT doc_id, line, pos, word, ro, dd, CASE WHEN regexp_replace(word, '[\\[\\]⸢⸣()]', '', 'g') = 'x' THEN 'illegible_x' WHEN r THEN 'restored' WHEN d THEN 'laes' ELSE 'attested' END AS state FROM sr)"""
_BARE = "regexp_replace(word, '[\\[\\]⸢⸣()]', '', 'g')"

QUERIES = {f.__name__: f for f in (
    milestone_state_counts, restored_run_lengths, event_runs, line_word_counters, word_classes, sign_states, line_labels, parser_oracle, codepoint_classes,
    schema_census, site_prefixes, relation_bases, structural_relations)}

_LAB = "'^((?:\\p{L}+\\. ?)*)([0-9]+)(′?) '"
SQL = {
    "milestone_state_counts": f"WITH {_ST} SELECT doc_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in st.STATES) + " FROM ws GROUP BY doc_id",
    "restored_run_lengths": f"WITH {_ST}, g AS (SELECT doc_id, state, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, state ORDER BY pos) AS g FROM ws), "
                            "l AS (SELECT count(*) AS n FROM g WHERE state = 'restored' GROUP BY doc_id, g) SELECT least(n, 20) AS length, count(*) AS runs FROM l GROUP BY 1",
    "event_runs": "WITH g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events), "
                  "l AS (SELECT event_type, count(*) AS n FROM g GROUP BY user_id, event_type, g) SELECT event_type, least(n, 20) AS length, count(*) AS runs FROM l GROUP BY ALL",
    "line_word_counters": "WITH r AS (SELECT doc_id, len(list_filter(string_split_regex(s, '[ \t\r]+'), lambda z: z <> '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL)) "
                          "SELECT doc_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (n = 0) AS blank_lines, CAST(max(n) AS INTEGER) AS longest_line FROM r GROUP BY doc_id",
    "word_classes": f"WITH {_W}, c AS (SELECT lang, CASE WHEN regexp_full_match({_BARE}, '[0-9]+') OR {_BARE} = '<NUM>' THEN 'number' WHEN regexp_matches({_BARE}, '^\\{{[^{{}}]+\\}}') THEN 'determinative' "
                    f"WHEN regexp_full_match({_BARE}, '\\p{{Lu}}[\\p{{Lu}}.]+(-.*)?') THEN 'logogram' WHEN contains({_BARE}, '-') THEN 'syllabic' ELSE 'plain' END AS class FROM wd JOIN documents USING (doc_id)) SELECT lang, class, count(*) AS words FROM c GROUP BY ALL",
    "sign_states": f"""WITH {_ST}, sg AS (SELECT ro, dd, p[i] AS sign, array_to_string(p[1:i - 1], '-') AS b, i FROM (SELECT ro, dd, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT ro, dd, string_split(word, '-') AS p FROM ws)) WHERE p[i] <> ''),
        k AS (SELECT sign, length(b) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS o, CASE WHEN regexp_replace(sign, '[\\[\\]⸢⸣()]', '', 'g') = 'x' THEN 'illegible_x'
            WHEN coalesce({_mark('[', ']', 'b')} = 1, ro) OR regexp_matches(sign, '^[⸢(]*\\[') THEN 'restored' WHEN coalesce({_mark('⸢', '⸣', 'b')} = 1, dd) OR regexp_matches(sign, '^[\\[(]*⸢') THEN 'laes' ELSE 'attested' END AS state FROM sg)
        SELECT state, count(*) AS signs, CAST(sum(o) AS BIGINT) AS offsets, count(DISTINCT sign) AS kinds FROM k GROUP BY state""",
    "line_labels": f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL), "
                   f"p AS (SELECT trim(regexp_extract(s, {_LAB}, 1)) AS h, regexp_extract(s, {_LAB}, 2) AS n, regexp_extract(s, {_LAB}, 3) AS q FROM l) "
                   "SELECT CASE WHEN h = '' THEN NULL " + " ".join(f"WHEN h = '{k}' THEN '{v}'" for k, v in st.SIDES.items()) + " ELSE 'other' END AS side, CASE WHEN n <> '' THEN q <> '' END AS prime, count(*) AS lines, max(CASE WHEN n <> '' THEN CAST(n AS INTEGER) END) AS highest FROM p GROUP BY ALL",
    "parser_oracle": f"WITH {_ST}, o AS (SELECT doc_id, length(text) - length(replace(text, '[', '')) AS opens FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, count(*) FILTER (state = 'restored') AS restored FROM ws GROUP BY doc_id), "
                     "b AS (SELECT opens, coalesce(restored, 0) AS restored FROM o LEFT JOIN p USING (doc_id)) SELECT count(*) AS documents, count(*) FILTER (opens = restored) AS equal, round(avg(abs(opens - restored)), 6) AS mean_difference, round(corr(opens, restored), 6) AS correlation FROM b",
    "codepoint_classes": "WITH c AS (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM documents WHERE text IS NOT NULL AND text <> '') SELECT CASE WHEN cp < 128 THEN 'ascii' WHEN cp < 256 THEN 'latin1' WHEN cp < 592 THEN 'latin_extended' WHEN cp BETWEEN 768 AND 879 THEN 'combining' "
                         "WHEN cp BETWEEN 8192 AND 8303 THEN 'punctuation' WHEN cp BETWEEN 8320 AND 8351 THEN 'subscript' WHEN cp BETWEEN 73728 AND 75087 THEN 'wedge_sign' ELSE 'other' END AS class, count(*) AS characters FROM c GROUP BY 1",
    "schema_census": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\{\\p{L}+\\}|<[A-Za-z]+>)', 1)) AS tag FROM documents WHERE text IS NOT NULL) SELECT tag, count(*) AS instances, count(DISTINCT doc_id) AS documents FROM t GROUP BY tag",
    "site_prefixes": "WITH c AS (SELECT string_split(doc_id, ' ')[1] AS prefix, site, count(*) AS n FROM splits WHERE site IS NOT NULL GROUP BY ALL) SELECT prefix, arg_min(site, {'m': -n, 's': site}) AS site, max(n) AS n, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY prefix",
    "relation_bases": "WITH p AS (SELECT DISTINCT pair_id, join_type, tier, fragment_id_a, fragment_id_b FROM join_pairs), s AS (SELECT *, coalesce(string_split(fragment_id_a, '::')[1] = string_split(fragment_id_b, '::')[1], false) AS adj FROM p) "
                      "SELECT CASE WHEN adj AND join_type = '+' THEN 'direct' WHEN adj AND join_type = '(+)' THEN 'indirect' WHEN NOT adj AND join_type = 'inferred' THEN 'inferred' ELSE 'unknown' END AS basis, tier, count(*) AS pairs FROM s GROUP BY ALL",
    "structural_relations": "WITH l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS a FROM lineitem GROUP BY 1), p AS (SELECT x.a, y.a AS b, list_intersect(x.a, y.a) AS c FROM l x JOIN l y ON y.k = x.k + 1), "
                            "d AS (SELECT a, b, c, len(list_distinct(list_transform(c, lambda z: list_position(b, z) - list_position(a, z)))) AS n FROM p) "
                            "SELECT CASE WHEN len(c) > 0 THEN 'overlap' WHEN list_max(a) < list_min(b) THEN 'a_before_b' WHEN list_max(b) < list_min(a) THEN 'b_before_a' ELSE 'interleaved_without_shared_rows' END AS ordering, len(c) > 0 AND n = 1 AS identifiable, n <= 1 AS consistent, count(*) AS pairs, CAST(sum(len(c)) AS BIGINT) AS shared FROM d GROUP BY ALL",
}
