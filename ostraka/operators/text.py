"""Documents and fragments as lines and tokens, with their families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[ \t\r]+"


def tokens(c: Column) -> Column:
    """Pieces between blanks; a null text has no tokens."""
    return F.coalesce(F.filter(F.split(c, BLANKS), lambda t: t != ""), F.array().cast("array<string>"))


def lines(documents: DataFrame, *keep: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``keep``..., line, tokens): one row per line that has tokens, lines numbered from 0."""
    cut = documents.where(F.col(text).isNotNull()).select(key, *keep, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    return cut.select(key, *keep, "line", tokens(F.col("s")).alias("tokens")).where(F.size("tokens") > 0)


def families(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, family): documents with equal texts are not independent; the least key names their family.

    Documents without a text are families of their own. The shuffle is on a digest of the text,
    not on the text, and the least key of a digest is partially aggregated before it.
    """
    digest = F.sha2(F.col(text), 256)
    keyed = documents.select(key, digest.alias("d"))
    least = keyed.where("d is not null").groupBy("d").agg(F.min(key).alias("family"))
    return keyed.join(least, "d", "left").select(key, F.coalesce("family", key).alias("family"))


def fragments(failures: DataFrame) -> DataFrame:
    """(fragment_id, parent, tokens): distinct fragments of a retrieval log with a rendering."""
    sides = failures.select(F.explode(F.array(
        F.struct(F.col("query_id").alias("id"), F.col("query_rendering").alias("r")),
        F.struct(F.col("predicted").alias("id"), F.col("predicted_rendering").alias("r")),
    )).alias("s")).select(F.col("s.id").alias("fragment_id"), F.array_join(F.filter(F.split("s.r", "[ \t\r\n]+"), lambda t: t != ""), " ").alias("text"))
    one = sides.where("fragment_id is not null and text <> ''").groupBy("fragment_id").agg(F.max("text").alias("text"))
    return one.select("fragment_id", parent(F.col("fragment_id")).alias("parent"), F.split("text", " ").alias("tokens"))


def parent(fragment: Column) -> Column:
    """The document a fragment belongs to: what stands before the member mark."""
    return F.element_at(F.split(fragment, "::"), 1)
