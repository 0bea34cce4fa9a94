"""Queries over records that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rejects
from ..sources.tables import table


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "parse_errors_raw", "raw_id", "raw_record")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected(_raw(spark, sf))


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.loaded(_raw(spark, sf))


def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.judged(_raw(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_KINDS = "mismatched tag|not well-formed \\(invalid token\\)|syntax error|no element found|duplicate attribute|undefined entity"
_JUDGED = rf"""
WITH rec AS (SELECT raw_id, coalesce(regexp_replace(raw_record, '(\r\n|\n|\r)$', ''), '') AS t FROM parse_errors_raw),
shape AS (SELECT raw_id, t,
    regexp_full_match(t, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS ok,
    regexp_full_match(t, '("([^"]|"")*"|[^",]*),("([^"]|"")*"|[^",]*)', 's') AS two,
    regexp_extract(t, '^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', 1, 's') AS f,
    regexp_extract(t, '^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', 2, 's') AS e FROM rec),
val AS (SELECT raw_id, t, ok, two,
    CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END AS file,
    CASE WHEN starts_with(e, '"') THEN replace(e[2:-2], '""', '"') ELSE e END AS error FROM shape),
judged AS (SELECT raw_id, file, error, CASE WHEN NOT ok THEN 'broken_quoting' WHEN NOT two OR t = '' THEN 'wrong_column_count'
    WHEN NOT (regexp_full_match(file, '[^/]+/CTH [1-9][0-9]*_XML/[^/]+\.xml', 's') AND NOT regexp_matches(file, '[\x00-\x1f\x{{FFFD}}]')
          AND regexp_full_match(error, '({_KINDS}): line [1-9][0-9]*, column (0|[1-9][0-9]*)', 's')) THEN 'invalid_value' END AS reason FROM val)
"""

QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "p4_reasons": p4_reasons}
SQL = {
    "p4_found": _JUDGED + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": _JUDGED + "SELECT raw_id, file, error FROM judged WHERE reason IS NULL",
    "p4_reasons": _JUDGED + "SELECT reason, count(*) AS n FROM judged GROUP BY reason",
}
