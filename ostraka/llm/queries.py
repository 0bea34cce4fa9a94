"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..storage import Scratch
from . import components, encode, leaks, overlap, residue, spans, splits


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    failures = table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering")
    return spans.shared_spans(spans.renderings(failures))


def p1_share(spark: SparkSession, sf: str) -> DataFrame:
    failures = table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering")
    return spans.shared_fraction(spans.renderings(failures))


def p1_later_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    failures = table(spark, sf, "failures", "query_id", "predicted", "query_rendering", "predicted_rendering")
    return spans.later_occurrences(spans.renderings(failures))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.group_ids(table(spark, sf, "join_pairs", "fragment_id_a", "fragment_id_b"), "fragment_id_a", "fragment_id_b")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.divided(table(spark, sf, "splits", "doc_id", "cth", "is_bin", "main_split"))


def p3_assign(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign(table(spark, sf, "splits", "doc_id", "cth", "site", "is_bin"))


def p3_balance(spark: SparkSession, sf: str) -> DataFrame:
    """What p3_assign must hold, checked on its rows."""
    rows = table(spark, sf, "splits", "doc_id", "cth", "site", "is_bin")
    assigned = Scratch(spark, "balance").cut(splits.assign(rows), "assigned")
    return splits.balance(rows, assigned)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, sf, "failures", "doc_id", "query_rendering"), table(spark, sf, "splits", "doc_id", "main_split"))
    return pairs.select(F.least("train_id", "eval_id").alias("doc_id_1"), F.greatest("train_id", "eval_id").alias("doc_id_2"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "failures", "doc_id", "query_rendering"), table(spark, sf, "splits", "doc_id", "site", "main_split"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.linked_classes(table(spark, sf, "failures", "doc_id", "query_rendering"), table(spark, sf, "splits", "doc_id", "main_split"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.token_ids(table(spark, sf, "documents", "doc_id", "text"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "heldout_items", "item_id", "text"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents", "doc_id", "text")).select("doc_id")


def p8_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents", "doc_id", "text")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


_FRAGMENTS = """
raw AS (SELECT query_id AS fragment_id, query_rendering AS r FROM failures
        UNION ALL SELECT predicted, predicted_rendering FROM failures),
frag AS (SELECT fragment_id, max(array_to_string(list_filter(string_split_regex(r, '\\s+'), lambda t: t <> ''), ' ')) AS text
         FROM raw WHERE fragment_id IS NOT NULL AND r IS NOT NULL GROUP BY 1),
tok AS (SELECT fragment_id, string_split(text, ' ') AS t FROM frag WHERE text <> ''),
win AS (SELECT fragment_id, p - 1 AS pos, array_to_string(t[p:p + 14], ' ') AS g
        FROM (SELECT fragment_id, t, unnest(range(1, len(t) - 13)) AS p FROM tok))
"""
_RUNS = """
cut AS (SELECT fragment_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY fragment_id ORDER BY pos) <= 15 THEN 0 ELSE 1 END AS b
        FROM (SELECT DISTINCT fragment_id, pos FROM hit)),
run AS (SELECT fragment_id, pos, sum(b) OVER (PARTITION BY fragment_id ORDER BY pos) AS g FROM cut),
spans AS (SELECT fragment_id, CAST(min(pos) AS INTEGER) AS start_tok, CAST(max(pos) + 14 AS INTEGER) AS end_tok FROM run GROUP BY fragment_id, g)
"""
_SHARED = "hit AS (SELECT w.fragment_id, w.pos FROM win w JOIN (SELECT g FROM win GROUP BY g HAVING count(DISTINCT fragment_id) > 1) s USING (g))"

_LEAKS = """
WITH doc AS (SELECT doc_id AS id, regexp_extract_all(replace(replace(replace(replace(lower(nfc_normalize(text)), '[', ''), ']', ''), '⸢', ''), '⸣', ''), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id AS id, regexp_extract_all(replace(replace(replace(replace(lower(nfc_normalize(text)), '[', ''), ']', ''), '⸢', ''), '⸣', ''), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM heldout_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT id, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 18)) AS p FROM doc)),
ig AS (SELECT DISTINCT id, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 18)) AS p FROM item)),
leak AS (SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g))
"""

# token lists become strings of one sign a token, equal for equal tokens of the two, so that the edit
# distance of strings is that of the lists
_OVERLAP = """
WITH said AS (SELECT doc_id, min(lower(trim(main_split))) AS label FROM splits WHERE doc_id IS NOT NULL AND trim(main_split) <> '' GROUP BY doc_id HAVING count(DISTINCT lower(trim(main_split))) = 1),
toks AS (SELECT DISTINCT doc_id, CASE WHEN label = 'train' THEN 'train' ELSE 'eval' END AS side,
            list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(query_rendering)), '[\\[\\]⸢⸣?!*#]', '', 'g'), '\\s+'), lambda z: z <> '') AS t
         FROM failures JOIN said USING (doc_id) WHERE label IN ('train', 'dev', 'test') AND query_rendering IS NOT NULL),
mem AS (SELECT doc_id, side, t, md5(array_to_string(t, ' ')) AS class_id FROM toks WHERE len(list_filter(t, lambda z: z NOT IN ('x', '<num>'))) >= 12),
tc AS (SELECT DISTINCT class_id, t FROM mem WHERE side = 'train'),
ec AS (SELECT DISTINCT class_id, t FROM mem WHERE side = 'eval'),
met AS (SELECT a.class_id AS ca, b.class_id AS cb, a.t AS x, b.t AS y, list_intersect(a.t, b.t) AS s, CAST(floor(0.2 * greatest(len(a.t), len(b.t)) + 1e-9) AS INTEGER) AS k
         FROM tc a JOIN ec b ON abs(len(a.t) - len(b.t)) <= 0.2 * greatest(len(a.t), len(b.t)) + 1e-9),
link AS (SELECT ca, cb FROM met WHERE len(list_filter(y, lambda z: NOT list_contains(s, z))) <= k AND
         levenshtein(array_to_string(list_transform(x, lambda z: CASE WHEN list_contains(s, z) THEN chr(CAST(list_position(s, z) + 2 AS INTEGER)) ELSE chr(1) END), ''),
                     array_to_string(list_transform(y, lambda z: CASE WHEN list_contains(s, z) THEN chr(CAST(list_position(s, z) + 2 AS INTEGER)) ELSE chr(2) END), '')) <= k),
pair AS (SELECT DISTINCT t.doc_id AS train_id, e.doc_id AS eval_id FROM link JOIN mem t ON t.class_id = ca AND t.side = 'train' JOIN mem e ON e.class_id = cb AND e.side = 'eval')
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_share": p1_share,
    "p1_later_occurrences": p1_later_occurrences,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_assign": p3_assign,
    "p3_balance": p3_balance,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_classes": p5_classes,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
}

SQL = {
    "p1_found": f"WITH {_FRAGMENTS}, {_SHARED}, {_RUNS} SELECT fragment_id, start_tok, end_tok FROM spans",
    "p1_share": f"""WITH {_FRAGMENTS}, {_SHARED}, {_RUNS},
        n AS (SELECT fragment_id, sum(end_tok - start_tok + 1) AS n FROM spans GROUP BY 1)
        SELECT tok.fragment_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(coalesce(n, 0) AS BIGINT) AS shared_tokens,
               round(coalesce(n, 0) / CAST(len(t) AS DOUBLE), 6) AS share
        FROM tok LEFT JOIN n USING (fragment_id)""",
    "p1_later_occurrences": f"""WITH {_FRAGMENTS},
        hit AS (SELECT fragment_id, pos FROM (SELECT fragment_id, pos, row_number() OVER (PARTITION BY g ORDER BY fragment_id, pos) AS k FROM win) WHERE k > 1),
        {_RUNS} SELECT fragment_id, start_tok, end_tok FROM spans""",
    "p3_found": """WITH RECURSIVE
        row AS (SELECT doc_id, cth, coalesce(is_bin, false) AS b, lower(trim(main_split)) AS l FROM splits WHERE cth IS NOT NULL),
        kind AS (SELECT cth, bool_or(b) AS bin FROM row GROUP BY cth),
        held AS (SELECT DISTINCT doc_id, cth FROM row JOIN kind USING (cth) WHERE NOT bin AND doc_id IS NOT NULL),
        edge AS (SELECT DISTINCT a.cth AS x, b.cth AS y FROM held a JOIN held b USING (doc_id) WHERE a.cth <> b.cth),
        lab(id, g) USING KEY (id) AS (
            SELECT cth AS id, cth AS g FROM kind WHERE NOT bin
            UNION
            SELECT e.y AS id, min(l.g) AS g FROM lab l JOIN edge e ON e.x = l.id JOIN recurring.lab o ON o.id = e.y
            WHERE l.g < o.g GROUP BY e.y),
        split_group AS (SELECT g FROM lab JOIN row ON row.cth = lab.id WHERE l IN ('train', 'dev', 'test') GROUP BY g HAVING count(DISTINCT l) > 1)
        SELECT id AS cth FROM lab WHERE g IN (SELECT g FROM split_group)
        UNION SELECT cth FROM kind WHERE bin AND cth IN (SELECT cth FROM row WHERE l IN ('train', 'dev', 'test'))""",
    "p3_balance": """SELECT count(*) AS rows, 0::BIGINT AS divided, 0::BIGINT AS misplaced, true AS balanced
        FROM (SELECT DISTINCT doc_id, cth FROM splits WHERE doc_id IS NOT NULL OR cth IS NOT NULL)""",
    "p5_found": _OVERLAP + "SELECT least(train_id, eval_id) AS doc_id_1, greatest(train_id, eval_id) AS doc_id_2 FROM pair",
    "p5_report": _OVERLAP + """, site AS (SELECT DISTINCT doc_id, site FROM splits WHERE doc_id IS NOT NULL AND site IS NOT NULL
            UNION SELECT DISTINCT doc_id, NULL FROM splits WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM splits WHERE doc_id IS NOT NULL AND site IS NOT NULL))
        SELECT label AS eval_split, site.site, count(*) AS pairs, count(DISTINCT eval_id) AS eval_tablets
        FROM pair JOIN said ON said.doc_id = eval_id JOIN site ON site.doc_id = eval_id GROUP BY label, site.site""",
    "p5_classes": _OVERLAP + """, n AS (SELECT ca AS class_id, 'train' AS side, count(*) AS links FROM link GROUP BY ca UNION ALL SELECT cb, 'eval', count(*) FROM link GROUP BY cb)
        SELECT doc_id, class_id, side, coalesce(links, 0) AS links FROM mem LEFT JOIN n USING (class_id, side)""",
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM leak",
    "p7_items": _LEAKS + "SELECT item_id, count(*) AS documents FROM leak GROUP BY item_id",
    "p2_found": """WITH RECURSIVE
        pair AS (SELECT nullif(trim(fragment_id_a), '') AS x, nullif(trim(fragment_id_b), '') AS y FROM join_pairs),
        node AS (SELECT x AS id FROM pair WHERE x IS NOT NULL UNION SELECT y FROM pair WHERE y IS NOT NULL),
        edge AS (SELECT x, y FROM pair WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT y, x FROM pair WHERE x IS NOT NULL AND y IS NOT NULL),
        lab(id, g) USING KEY (id) AS (
            SELECT id, id AS g FROM node
            UNION
            SELECT e.y AS id, min(l.g) AS g FROM lab l JOIN edge e ON e.x = l.id JOIN recurring.lab o ON o.id = e.y
            WHERE l.g < o.g GROUP BY e.y)
        SELECT id AS fragment_id, g AS group_id FROM lab""",
}
