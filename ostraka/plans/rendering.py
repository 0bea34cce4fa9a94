"""Queries of renderings, labels, names and failures to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import interleave_lines
from ..operators import audit, text
from ..operators import rendering as rn
from ..operators import structure as st
from ..sources.tables import spread, table
from .audit import _F as _FRAGS
from .audit import _L as _LABELS
from .structure import _BARE, _ST, _words


def renderings(spark: SparkSession, sf: str) -> DataFrame:
    """Every document rendered as signs, in full and attested only, and as ideograms: sizes, and a digest of the attested signs."""
    words = st.milestone_states(_words(spark, sf)).withColumn("class", st.word_class(F.col("word")))
    r = rn.rendered(words)
    return r.select("doc_id", F.size("full").alias("n_full"), "n_attested", F.size("ideograms").alias("n_ideograms"), F.md5(F.array_join("attested", " ")).alias("attested_md5"))


def _line_lists(spark: SparkSession, sf: str) -> DataFrame:
    lines = text.lines(spread(table(spark, sf, "documents", "doc_id", "text")))
    return lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "tokens"))), lambda x: x["tokens"]).alias("lines"))


def structured_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Lines between edges; an edge is lost where the text begins or ends inside brackets. And the plain window with line marks."""
    d = _line_lists(spark, sf)
    first, last = F.get(F.get("lines", F.lit(0)), F.lit(0)), F.element_at(F.element_at("lines", -1), -1)
    seq = rn.structured(F.col("lines"), first.startswith("["), last.endswith("]"))
    plain = interleave_lines(F.col("lines"), "<LINE>")
    return d.select("doc_id", F.size(seq).alias("n_structured"), F.md5(F.array_join(seq, " ")).alias("structured_md5"), F.md5(F.array_join(plain, " ")).alias("plain_md5"),
                    F.size(rn.informative(plain)).alias("n_informative"))


def _train_vocabulary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    frags = text.fragments(table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering"))
    train = table(spark, sf, "splits", "doc_id", "main_split").where(audit.clean_label(F.col("main_split")) == "train").select(F.col("doc_id").alias("parent")).distinct()
    return frags, rn.vocabulary(frags.join(train, "parent", "left_semi"), "fragment_id")


def fragment_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments as ids of the train vocabulary: their number, how many are unknown, and a digest of the list."""
    frags, vocab = _train_vocabulary(spark, sf)
    ids = rn.token_ids(frags, vocab, "fragment_id")
    unknown = F.size(F.filter("ids", lambda i: i == rn.SPECIALS.index("<UNK>")))
    return ids.select("fragment_id", F.size("ids").alias("n"), unknown.alias("unknown"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"))


def encoding_sanity(spark: SparkSession, sf: str) -> DataFrame:
    """Contract on encodings: fragments with more than a twentieth of unknown ids, and those without any known token."""
    e = fragment_ids(spark, sf)
    return e.agg(F.count(F.lit(1)).alias("fragments"), F.count_if(F.col("unknown") > 0.05 * F.col("n")).alias("too_unknown"), F.count_if(F.col("unknown") == F.col("n")).alias("without_content"))


def fine_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _words(spark, sf).select(F.explode(rn.fine_tokens(F.col("word"))).alias("piece"))
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents", "text").where("text is not null")).select(F.explode(F.split("text", "\n")).alias("s"))


def label_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Sides and columns of all lines read as labels."""
    parts = rn.full_label(F.col("s"))
    rows = _raw_lines(spark, sf).select(*[parts[n].alias(n) for n in ("siglum", "sigla", "side", "column")])
    return rows.groupBy("side", "column").agg(F.count(F.lit(1)).alias("lines"), F.count("siglum").alias("with_siglum"), F.sum(F.size("sigla")).alias("sigla"))


def side_columns(spark: SparkSession, sf: str) -> DataFrame:
    parts = rn.side_column_edge(F.col("s"))
    return _raw_lines(spark, sf).select(*[c.alias(n) for n, c in parts.items()]).groupBy(*parts).agg(F.count(F.lit(1)).alias("lines"))


def bin_titles(spark: SparkSession, sf: str) -> DataFrame:
    """First lines of documents as titles: which would name a catch-all bin; compositions that are bins in ``splits`` are the seeds."""
    seeds = table(spark, sf, "splits", "cth", "is_bin").where("is_bin and cth is not null").select("cth", F.lit(True).alias("seed")).distinct()
    docs = table(spark, sf, "documents", "doc_id", "text", "cth").where("text is not null").join(seeds, "cth", "left")
    told = rn.bin_title(F.get(F.split("text", "\n"), F.lit(0)), F.coalesce("seed", F.lit(False)))
    return docs.select(*[c.alias(n) for n, c in told.items()]).groupBy(*told).agg(F.count(F.lit(1)).alias("documents"))


def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms of tablet names, how many names share the letters and numbers, and the edit distance to the least of them."""
    names = table(spark, sf, "splits", "doc_id").where("doc_id is not null").distinct()
    keyed = rn.name_keys(names, "doc_id")
    least = keyed.groupBy("letters", "numbers").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("sharing"))
    return keyed.join(least, ["letters", "numbers"]).select("doc_id", "folded", "letters", "numbers", "sharing", F.levenshtein("doc_id", "least").alias("distance"))


def parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records of the error log by category of failure."""
    raw = table(spark, sf, "parse_errors_raw", "raw_id", "raw_record").where("raw_record is not null")
    column = F.coalesce(F.regexp_extract("raw_record", "column ([0-9]{1,6})", 1).try_cast("int"), F.lit(0))
    category = rn.parse_failure(F.col("raw_record"), F.col("raw_record"), column, F.col("raw_record"))
    return raw.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("records"))


def genre_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per hundred of composition numbers and per quarter of length, the edges belonging to the lower quarter."""
    docs = table(spark, sf, "documents", "doc_id", "text", "cth").select("cth", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    edges = docs.agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    met = docs.join(F.broadcast(edges))  # one row
    band = F.when(F.col("n") <= F.col("q")[0], "q1").when(F.col("n") <= F.col("q")[1], "q2").when(F.col("n") <= F.col("q")[2], "q3").otherwise("q4")
    return met.groupBy((F.floor(F.col("cth") / 100) * 100).cast("int").alias("genre"), band.alias("length_band")).agg(F.count(F.lit(1)).alias("documents"))


LINE_BINS = [("none", 0, 0), ("short", 1, 5), ("middle", 6, 20), ("long", 21, None)]


def line_length_bins(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(text.tokens(F.col("s")))
    return _raw_lines(spark, sf).groupBy(rn.closed_bin(n, LINE_BINS).alias("bin")).agg(F.count(F.lit(1)).alias("lines"))


def relation_families(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of fragments by what all their rows together rest on."""
    pairs = table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b", "join_type").where("fragment_id_a is not null and fragment_id_b is not null and join_type is not null")
    per = pairs.groupBy(F.least("fragment_id_a", "fragment_id_b").alias("a"), F.greatest("fragment_id_a", "fragment_id_b").alias("b")).agg(F.collect_set("join_type").alias("types"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(rn.basis_family(F.col("types")).alias("family")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("rows"))


TERMS = ("court", "gate", "temple", "house", "hill", "city")


def schema_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Which terms stand in which names of sites."""
    names = table(spark, sf, "splits", "site").where("site is not null").distinct()
    terms = names.select("site", F.explode(F.array(*[F.lit(t) for t in TERMS])).alias("term"))
    return terms.where(rn.names_term(F.col("site"), F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("sites"))


_CLASS = (f"CASE WHEN regexp_full_match({_BARE}, '[0-9]+') OR {_BARE} = '<NUM>' THEN 'number' WHEN regexp_matches({_BARE}, '^\\{{[^{{}}]+\\}}') THEN 'determinative' "
          f"WHEN regexp_full_match({_BARE}, '\\p{{Lu}}[\\p{{Lu}}.]+(-.*)?') THEN 'logogram' WHEN contains({_BARE}, '-') THEN 'syllabic' ELSE 'plain' END")
_SIGNS = "list_filter(string_split(b, '-'), lambda z: z <> '')"
_TOK = f"CASE WHEN b = '' THEN []::VARCHAR[] WHEN c = 'number' THEN ['<NUM>'] WHEN c IN ('logogram', 'determinative') THEN [b] ELSE {_SIGNS} END"
_LN = """ll AS (SELECT doc_id, list(t ORDER BY line) AS ls FROM (SELECT doc_id, line, list_filter(string_split_regex(s, '[ \t\r]+'), lambda z: z <> '') AS t FROM (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL)) WHERE len(t) > 0 GROUP BY doc_id),
sq AS (SELECT doc_id, ls, string_split(array_to_string(list_transform(ls, lambda z: array_to_string(z, ' ')), ' <LINE> '), ' ') AS p FROM ll)"""
_RAW = "rl AS (SELECT unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL)"
_VOC = f"""WITH {_LABELS}, {_FRAGS}, v AS (SELECT token, row_number() OVER (ORDER BY token) + {len(rn.SPECIALS) - 1} AS id FROM (
    SELECT unnest(list_distinct(t)) AS token FROM fg WHERE parent IN (SELECT doc_id FROM lab WHERE label = 'train')) GROUP BY token HAVING count(*) >= 2),
en AS (SELECT f.id AS fragment_id, list(coalesce(v.id, {rn.SPECIALS.index('<UNK>')}) ORDER BY k) AS ids FROM (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS k FROM fg) f LEFT JOIN v USING (token) GROUP BY f.id),
fi AS (SELECT fragment_id, CAST(len(ids) AS INTEGER) AS n, CAST(len(list_filter(ids, lambda z: z = {rn.SPECIALS.index('<UNK>')})) AS INTEGER) AS unknown, md5(array_to_string(ids, ',')) AS ids_md5 FROM en)"""
_SIDE_SQL = "CASE WHEN w = '' THEN NULL " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in st.SIDES.items()) + " ELSE 'other' END"
_BINRE = rn.BIN_WORDS.replace("(?i)", "")

QUERIES = {f.__name__: f for f in (
    renderings, structured_sequences, fragment_ids, encoding_sanity, fine_token_counts, label_parts, side_columns, bin_titles, name_forms, parse_failures, genre_bands,
    line_length_bins, relation_families, schema_terms)}

SQL = {
    "renderings": f"""WITH {_ST}, cl AS (SELECT doc_id, pos, state, {_BARE} AS b, {_CLASS} AS c FROM ws),
        tk AS (SELECT doc_id, pos, {_TOK} AS f, CASE WHEN state = 'restored' THEN []::VARCHAR[] ELSE {_TOK} END AS a, CASE WHEN c = 'logogram' THEN 1 ELSE 0 END AS i FROM cl),
        g AS (SELECT doc_id, flatten(list(f ORDER BY pos)) AS f, flatten(list(a ORDER BY pos)) AS a, sum(i) AS i FROM tk GROUP BY doc_id)
        SELECT doc_id, CAST(len(f) AS INTEGER) AS n_full, CAST(len(a) AS INTEGER) AS n_attested, CAST(i AS INTEGER) AS n_ideograms, md5(array_to_string(a, ' ')) AS attested_md5 FROM g""",
    "structured_sequences": f"""WITH {_LN}, x AS (SELECT doc_id, p, list_concat([CASE WHEN starts_with(p[1], '[') THEN '<GAP>' ELSE '<EDGE_T>' END], p, [CASE WHEN ends_with(p[-1], ']') THEN '<GAP>' ELSE '<EDGE_B>' END]) AS q FROM sq)
        SELECT doc_id, CAST(len(q) AS INTEGER) AS n_structured, md5(array_to_string(q, ' ')) AS structured_md5, md5(array_to_string(p, ' ')) AS plain_md5,
        CAST(len(list_filter(p, lambda z: z NOT IN ({', '.join(repr(x) for x in (*rn.SPECIALS, '<NUM>', '<PAR>', 'x'))}))) AS INTEGER) AS n_informative FROM x""",
    "fragment_ids": f"{_VOC} SELECT * FROM fi",
    "encoding_sanity": f"{_VOC} SELECT count(*) AS fragments, count(*) FILTER (unknown > 0.05::DOUBLE * n) AS too_unknown, count(*) FILTER (unknown = n) AS without_content FROM fi",
    "fine_token_counts": f"""WITH {_ST.split('mk AS')[0].rstrip().rstrip(',')}, b AS (SELECT {_BARE} AS t FROM wd),
        p AS (SELECT unnest(CASE WHEN regexp_full_match(t, '[§=_]+') THEN ['<PAR>'] WHEN regexp_full_match(t, '[0-9]+') OR t = '<NUM>' THEN ['<NUM>']
            WHEN regexp_full_match(t, '\\p{{Lu}}[\\p{{Lu}}×.]+(-.*)?') THEN CASE WHEN contains(t, '×') THEN string_split(t, '-') ELSE string_split_regex(t, '[-.]') END ELSE string_split(lower(t), '-') END) AS piece FROM b)
        SELECT piece, count(*) AS n FROM p WHERE piece <> '' GROUP BY piece""",
    "label_parts": f"""WITH {_RAW}, g AS (SELECT regexp_extract(s, '^\\s*\\{{€([0-9+]+)\\}}\\s*', 1) AS g, trim(regexp_replace(s, '^\\s*\\{{€([0-9+]+)\\}}\\s*', '')) AS r FROM rl),
        h AS (SELECT CASE WHEN g <> '' THEN string_split(g, '+') ELSE []::VARCHAR[] END AS sg, list_filter(string_split(trim(regexp_extract(r, '^((?:[^0-9 ]+(?: |$))*)', 1)), ' '), lambda z: z <> '') AS p FROM g),
        k AS (SELECT sg, list_filter(p, lambda z: regexp_full_match(z, '[IVX]+')) AS ro, array_to_string(list_filter(p, lambda z: NOT regexp_full_match(z, '[IVX]+')), ' ') AS w FROM h)
        SELECT {_SIDE_SQL} AS side, ro[-1] AS "column", count(*) AS lines, count(*) FILTER (len(sg) = 1) AS with_siglum, CAST(sum(len(sg)) AS BIGINT) AS sigla FROM k GROUP BY ALL""",
    "side_columns": f"""WITH {_RAW}, t AS (SELECT trim(s) AS s FROM rl), p AS (SELECT
        CASE WHEN regexp_matches(s, '\\bu\\.\\s*Rd\\.?') THEN 'lower' WHEN regexp_matches(s, '\\bo\\.\\s*Rd\\.?') THEN 'upper' WHEN regexp_matches(s, '\\blk\\.\\s*Rd\\.?') THEN 'left' WHEN regexp_matches(s, '\\b(r|re)\\.\\s*Rd\\.?') THEN 'right' END AS edge,
        CASE WHEN regexp_matches(s, '\\bSeite\\s*A\\b') THEN 'side_A' WHEN regexp_matches(s, '\\bSeite\\s*B\\b') THEN 'side_B' WHEN regexp_matches(s, '\\bVs\\.?') OR regexp_matches(s, '\\bobv\\.?', 'i') THEN 'obverse'
             WHEN regexp_matches(s, '\\bRs\\.?') OR regexp_matches(s, '\\brev\\.?', 'i') THEN 'reverse' END AS side,
        CASE WHEN regexp_matches(s, '\\b(lk|li|l)\\.\\s*(Kol|col)\\.?', 'i') THEN 'left' WHEN regexp_matches(s, '\\b(r|re)\\.\\s*(Kol|col)\\.?', 'i') THEN 'right'
             WHEN regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(I{{1,3}}|IV|VI?)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1) <> '' THEN regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(I{{1,3}}|IV|VI?)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1)
             WHEN regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(i{{1,3}}|iv|vi?)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1) <> '' THEN upper(regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(i{{1,3}}|iv|vi?)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1)) END AS "column",
        contains(s, '?') OR contains(s, '!') AS uncertain FROM t) SELECT side, "column", edge, uncertain, count(*) AS lines FROM p GROUP BY ALL""",
    "bin_titles": f"""WITH sd AS (SELECT DISTINCT cth FROM splits WHERE is_bin AND cth IS NOT NULL), t AS (SELECT string_split(text, chr(10))[1] AS t, cth IS NOT NULL AND cth IN (SELECT cth FROM sd) AS seed FROM documents WHERE text IS NOT NULL),
        k AS (SELECT regexp_matches(t, '{_BINRE}', 'i') AS h, len(list_filter(string_split_regex(t, '\\s+'), lambda z: z <> '')) AS n, seed FROM t)
        SELECT h AND n <= 6 AS is_bin, (h AND n > 6) OR (NOT h AND seed) AS uncertain, CASE WHEN NOT h AND seed THEN 'seeded_without_word' WHEN NOT h THEN 'no_word' WHEN n <= 6 THEN 'word_in_short_title' ELSE 'word_in_long_title' END AS reason,
        count(*) AS documents FROM k GROUP BY ALL""",
    "name_forms": """WITH k AS (SELECT DISTINCT doc_id, lower(doc_id) AS folded, regexp_replace(lower(strip_accents(doc_id)), '[^a-z]', '', 'g') AS letters, array_to_string(regexp_extract_all(doc_id, '[0-9]+'), '.') AS numbers FROM splits WHERE doc_id IS NOT NULL),
        l AS (SELECT letters, numbers, min(doc_id) AS least, count(*) AS sharing FROM k GROUP BY ALL) SELECT doc_id, folded, letters, numbers, sharing, CAST(levenshtein(doc_id, least) AS INTEGER) AS distance FROM k JOIN l USING (letters, numbers)""",
    "parse_failures": """WITH r AS (SELECT raw_record AS s, CAST(coalesce(nullif(regexp_extract(raw_record, 'column ([0-9]{1,6})', 1), ''), '0') AS INTEGER) AS c FROM parse_errors_raw WHERE raw_record IS NOT NULL)
        SELECT CASE WHEN contains(s, '<AO:-LineNrExpl') THEN 'invalid_qname_ao_dash_linenr'
            WHEN contains(s, 'invalid token') AND s[c + 1:c + 2] = '</' AND length(regexp_replace(s[1:c], '[^"]', '', 'g')) % 2 = 1 THEN 'unescaped_markup_inside_attribute'
            WHEN contains(s, '<AO:TxtPubl>') AND contains(s, '</TxtPubl>') THEN 'namespace_prefix_mismatch'
            WHEN contains(s, 'mismatched tag') AND length(s) - length(replace(s, '<sGr>', '')) > (length(s) - length(replace(s, '</sGr>', ''))) * 5.0 / 6 AND contains(s, '</w>') THEN 'unclosed_inline_element_before_word_close'
            ELSE 'unclassified_parse_failure' END AS category, count(*) AS records FROM r GROUP BY 1""",
    "genre_bands": """WITH d AS (SELECT cth, coalesce(length(text), 0) AS n FROM documents), e AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM d)
        SELECT CAST(floor(cth / 100.0) * 100 AS INTEGER) AS genre, CASE WHEN n <= a THEN 'q1' WHEN n <= b THEN 'q2' WHEN n <= c THEN 'q3' ELSE 'q4' END AS length_band, count(*) AS documents FROM d, e GROUP BY ALL""",
    "line_length_bins": f"WITH {_RAW}, n AS (SELECT len(list_filter(string_split_regex(s, '[ \t\r]+'), lambda z: z <> '')) AS n FROM rl) SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 5 THEN 'short' WHEN n <= 20 THEN 'middle' ELSE 'long' END AS bin, count(*) AS lines FROM n GROUP BY 1",
    "relation_families": """WITH p AS (SELECT least(fragment_id_a, fragment_id_b) AS a, greatest(fragment_id_a, fragment_id_b) AS b, list_sort(list(DISTINCT join_type)) AS t, count(*) AS n FROM join_pairs WHERE fragment_id_a IS NOT NULL AND fragment_id_b IS NOT NULL AND join_type IS NOT NULL GROUP BY 1, 2)
        SELECT CASE WHEN len(t) = 1 THEN t[1] || '_only' ELSE 'mixed:' || array_to_string(t, '+') END AS family, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY 1""",
    "schema_terms": "WITH s AS (SELECT DISTINCT site FROM splits WHERE site IS NOT NULL) SELECT term, count(*) AS sites FROM s, unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) u(term) WHERE contains(regexp_replace(lower(site), '[^a-z0-9]', '', 'g'), term) GROUP BY term",
}
