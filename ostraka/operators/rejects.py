"""Rows that fail to parse: loaded where sound, set apart with the reason where not.

Structure is judged on each record: quoting by looking at the pieces between quote signs, column
count by the commas outside quotes. The parsed records are written once, so every later step reads
fields and no record is parsed again. Values are judged once each: the distinct values of a
column are cast, the ones that fail make a dictionary of invalid values with their reasons, and
the dictionary is joined back to the records. All of it is JVM-side and linear in the text, with
no pattern that backtracks over a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: The kinds an error may have.
KINDS = ("mismatched tag", "not well-formed (invalid token)", "syntax error", "no element found", "duplicate attribute", "undefined entity")
_NUMBER = "(?:0|[1-9][0-9]*)"
_CONTROL = r"[\x00-\x1f]"


def _record(c: Column) -> Column:
    """The record without one final line end (LF, CR LF or CR)."""
    return F.regexp_replace(c, r"(?:\r\n|\n|\r)\z", "")


def _outside(i: Column) -> Column:
    return i % 2 == 0


def parsed(raw: DataFrame, key: str = "raw_id", record: str = "raw_record") -> DataFrame:
    """(``key``, columns, quoting_ok, fields): structure of each record; ``fields`` unquoted where the quoting holds."""
    text = F.coalesce(_record(F.col(record).cast("string")), F.lit(""))
    base = raw.select(F.col(key), text.alias("t")).withColumn("p", F.split("t", '"', -1))
    last = F.size("p") - 1

    def sound(s: Column, i: Column) -> Column:
        opens, closes = s.endswith(","), s.startswith(",")
        return (F.when(~_outside(i), True)
                .when(last == 0, True)
                .when(i == 0, (s == "") | opens)
                .when(i == last, (s == "") | closes)
                .otherwise((s == "") | (opens & closes)))

    # most records hold no quote sign: they need no walk over pieces, which is interpreted
    bare = F.instr("t", '"') == 0
    quoting = bare | ((last % 2 == 0) & ~F.exists(F.transform("p", lambda s, i: sound(s, i)), lambda ok: ~ok))
    # commas between fields become a sign that no sound value holds; one inside a quoted field goes to another such sign
    marked = F.array_join(F.transform("p", lambda s, i: F.when(_outside(i), F.translate(F.translate(s, "\x02", "\x01"), ",", "\x02")).otherwise(F.translate(s, "\x02", "\x01"))), '"')
    fields = F.transform(F.split(marked, "\x02", -1), lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    cut = F.when(F.col("t") == "", None).when(bare, F.split("t", ",", -1)).when(quoting, fields)
    return base.select(key, quoting.alias("quoting_ok"), cut.alias("fields")).withColumn("columns", F.coalesce(F.size("fields"), F.lit(0)))


def _file_reason(v: Column) -> Column:
    return (F.when(v.rlike(_CONTROL), "file_control_character")
            .when(F.instr(v, "�") > 0, "file_replacement_character")
            .when(~v.rlike(r"\A[^/]*/[^/]*/[^/]*\z"), "file_slashes")
            .when(~v.rlike(r"\A[^/]+/"), "file_archive")
            .when(~v.rlike(r"/CTH [1-9][0-9]*_XML/"), "file_composition")
            .when(~v.rlike(r"/[^/]+\.xml\z"), "file_stem"))


def _error_reason(v: Column) -> Column:
    kinds = "|".join("\\Q" + k + "\\E" for k in KINDS)
    return (F.when(v.rlike(_CONTROL), "error_control_character")
            .when(~v.rlike(rf"\A(?:{kinds}): "), "error_kind")
            .when(~v.rlike(rf"\A(?:{kinds}): line [1-9][0-9]*, column {_NUMBER}\z"), "error_position"))


def invalid_values(values: DataFrame, column: str, reason) -> DataFrame:
    """(``column``, ``column``_reason): the dictionary of the distinct values of ``column`` that cannot be cast.

    The reason hangs on the number of rows of a value, which only the aggregation makes: a reason of
    the value alone is a deterministic filter on the grouping column, which the optimizer moves
    below the aggregation, where it would be asked of every row.
    """
    distinct = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("held"))
    found = distinct.select(column, F.when(F.col("held") > 0, reason(F.col(column))).alias(f"{column}_reason"))
    return found.where(F.col(f"{column}_reason").isNotNull())


def judged(raw: DataFrame, key: str = "raw_id", record: str = "raw_record") -> DataFrame:
    """(``key``, file, error, reason, detail) of every record; reason null where the record is sound.

    Reasons, the first that holds: ``broken_quoting``, ``wrong_column_count`` (null and empty
    records too), ``invalid_value``, whose ``detail`` names the value's fault. Each row gets one
    verdict, repeated rows each their own; an empty table gives no rows; other columns are not
    read.
    """
    two = F.col("columns") == 2
    fields = parsed(raw, key, record).select(
        key, "quoting_ok", "columns", F.when(two, F.get("fields", F.lit(0))).alias("file"), F.when(two, F.get("fields", F.lit(1))).alias("error"))
    rows = Scratch(raw.sparkSession, "rejects").cut(fields, "rows")
    bad_file, bad_error = invalid_values(rows, "file", _file_reason), invalid_values(rows, "error", _error_reason)
    joined = rows.join(bad_file, "file", "left").join(bad_error, "error", "left")
    reason = (F.when(~F.col("quoting_ok"), "broken_quoting").when(F.col("columns") != 2, "wrong_column_count")
              .when(F.col("file_reason").isNotNull() | F.col("error_reason").isNotNull(), "invalid_value"))
    return joined.select(key, "file", "error", reason.alias("reason"), F.when(reason == "invalid_value", F.coalesce("file_reason", "error_reason")).alias("detail"))


def rejected(raw: DataFrame, key: str = "raw_id", record: str = "raw_record") -> DataFrame:
    """(``key``, reason): the records that fail to parse."""
    return judged(raw, key, record).where("reason is not null").select(key, "reason")


def loaded(raw: DataFrame, key: str = "raw_id", record: str = "raw_record") -> DataFrame:
    """(``key``, file, error): the sound records."""
    return judged(raw, key, record).where("reason is null").select(key, "file", "error")
